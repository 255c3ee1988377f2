"""Assertions as operators: a check is a row (name, ok, detail), and gate() fails on the first that is not ok."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """A gate that refuses to go on."""


def gate(checks: DataFrame) -> None:
    bad = checks.where("NOT ok").orderBy("name").limit(20).collect()
    if bad:
        raise CheckFailed("; ".join(f"{r['name']}: {r['detail']}" for r in bad))


def check(df: DataFrame, name: str, ok, detail) -> DataFrame:
    return df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.cast("string").alias("detail"))


def exact_count(df: DataFrame, name: str, want: int) -> DataFrame:
    return check(df.agg(F.count("*").alias("n")), name, F.col("n") == want, F.col("n"))


def within(df: DataFrame, name: str, value: str, want: float, tolerance: float) -> DataFrame:
    return check(df, name, F.abs(F.col(value) - want) <= tolerance, F.col(value))


def all_registered(df: DataFrame, column: str, registry: DataFrame, name: str) -> DataFrame:
    strange = df.select(column).distinct().join(registry.select(column).distinct(), column, "left_anti")
    return check(strange.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))


def disjoint(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    return check(a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))


def accounting_closes(report: DataFrame, name: str) -> DataFrame:
    """report has raw, kept, dropped, and by_reason whose sum must be dropped."""
    ok = (F.col("raw") == F.col("kept") + F.col("dropped")) & (F.col("by_reason") == F.col("dropped"))
    return check(report, name, ok, F.concat_ws("/", "raw", "kept", "dropped", "by_reason"))


def complete(df: DataFrame, expected: DataFrame, key: str, name: str) -> DataFrame:
    """Every expected key is there: no scoring with holes."""
    missing = expected.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")
    return check(missing.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return check(twice.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))


def shard_union(shards: DataFrame, whole: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """Checks that shards (shard, pos, key) are together whole (pos, key): sizes, gaps, repeats, order."""
    sized = shards.groupBy("shard").agg(F.count("*").alias("rows"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    wrong = sized.join(bounds, "shard", "full").where("NOT (rows <=> size AND hi - lo + 1 <=> rows)")
    moved = shards.select("pos", key).exceptAll(whole.select("pos", key))
    missing = whole.select("pos", key).exceptAll(shards.select("pos", key))
    count = lambda df, name: check(df.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))
    return count(wrong, "sizes").unionByName(count(moved, "moved")).unionByName(count(missing, "missing")).unionByName(unique(shards, [key], "duplicate_sources"))


def matched_share(df: DataFrame, registry: DataFrame, key: str, name: str, least: float = 0.80) -> DataFrame:
    """At least that share of the expected keys is met: a change of names shows as a low share. None expected fails."""
    expected = registry.select(key).distinct()
    met = expected.join(df.select(key).distinct().withColumn("met_", F.lit(1.0)), key, "left").agg(F.coalesce(F.avg(F.coalesce("met_", F.lit(0.0))), F.lit(0.0)).alias("share"))
    return check(met, name, F.col("share") >= least, F.round("share", 4))


def same_records(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Both frames hold the same records of every key that is on either side; columns are compared by name."""
    row = lambda df, to: df.select(key, F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256).alias(to))
    wrong = row(a, "x_").join(row(b, "y_"), key, "full").where("NOT (x_ <=> y_)")
    return check(wrong.agg(F.count("*").alias("n")), name, F.col("n") == 0, F.col("n"))


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows, whatever their order, under which results may be cached: 16 sums of hash parts and the count."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("long")).alias(f"p{i}")
    row = df.agg(F.count("*").alias("n"), *(part(i) for i in range(16))).first()
    import hashlib

    return hashlib.sha256(",".join(str(v) for v in row).encode()).hexdigest()
