"""Readers of line and TSV files under three policies for malformed rows: skip, count, fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def tsv(spark: SparkSession, path: str, columns: list[str], policy: str = "skip") -> DataFrame:
    """Rows of exactly len(columns) fields; quotes are data. skip drops others, count keeps them with
    `malformed` true and null fields, fail raises on the first."""
    raw = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    good = F.size("f") == len(columns)
    fields = [F.when(good, F.get("f", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    if policy == "count":
        return raw.select(*fields, (~good).alias("malformed"))
    if policy == "fail":
        message = F.concat(F.lit(f"expected {', '.join(columns)}: "), F.array_join("f", "\t"))
        return raw.select(*[F.when(good, F.get("f", F.lit(i))).otherwise(F.raise_error(message)).alias(c) for i, c in enumerate(columns)])
    return raw.where(good).select(*fields)


def fields(column: str, columns: list[str]) -> list:
    """The column's tab-separated fields by name; null if their number is another."""
    f = F.split(column, "\t", -1)
    return [F.when(F.size(f) == len(columns), F.get(f, F.lit(i))).alias(c) for i, c in enumerate(columns)]


def clips(spark: SparkSession, path: str) -> DataFrame:
    """(clip, text, lang) of rows with two or three fields; lang is null where there is none."""
    raw = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where(F.size("f").isin(2, 3))
    return raw.select(F.get("f", F.lit(0)).alias("clip"), F.get("f", F.lit(1)).alias("text"), F.get("f", F.lit(2)).alias("lang"))


def header_tsv(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader if quoted else reader.option("quote", "")).csv(path)


def column_or_second(df: DataFrame, name: str) -> DataFrame:
    """The column of that name, whatever its case, else the second."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    return df.select(F.col(found[0] if found else df.columns[1]).alias(name))


def aligned(a: DataFrame, b: DataFrame, equal: bool = False) -> DataFrame:
    """(line, a, b) of two (line, text) frames by line number; equal refuses sides of different lengths."""
    if equal and a.count() != b.count():
        raise ValueError("the sides differ in length")
    return a.withColumnRenamed("text", "a").join(b.withColumnRenamed("text", "b"), "line")


def with_file(df: DataFrame) -> DataFrame:
    """df of a file source with its file and the row's place in it."""
    return df.select("*", F.col("_metadata.file_path").alias("file"))


def parquet_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns with file and row index, so that a row can be addressed again."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
