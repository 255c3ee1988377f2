"""Writers: TSV without quoting, split folders, pipe CSV, one-row reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Refuses fields with tabs or line ends; by default refuses to overwrite."""
    safe = [F.when(F.col(c).cast("string").rlike("[\t\n\r]"), F.raise_error(F.lit(f"{c} holds a tab or a line end"))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    df.select(F.concat_ws("\t", *safe).alias("value")).write.mode(mode).text(path)


def splits(df: DataFrame, path: str, column: str = "split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(column).parquet(path)


def pipe_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Fields between pipes; a pipe in a text becomes a space."""
    flat = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit(" ")).alias(c) for c in df.columns]
    df.select(*flat).write.mode(mode).option("sep", "|").csv(path)


def report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row as a JSON document."""
    df.limit(1).coalesce(1).write.mode(mode).json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a small aggregate."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line("" if v is None else v for v in r) for r in rows)])


def aligned(df: DataFrame, path: str, a: str, b: str, order: str, mode: str = "errorifexists") -> None:
    """Two text folders whose lines correspond: both sides of a row are written by one task from one sorted frame.

    Line breaks inside a side become blanks. Part files of both folders have the same rows in the same order.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")
    sides = df.select(F.col(order).alias("at_"), F.explode(F.array(*(F.struct(F.lit(s).alias("side"), flat(s).alias("value")) for s in (a, b)))).alias("r"))
    rows = sides.select("at_", "r.side", "r.value").repartitionByRange("at_").sortWithinPartitions("side", "at_")
    rows.select("side", "value").write.mode(mode).partitionBy("side").text(path)
