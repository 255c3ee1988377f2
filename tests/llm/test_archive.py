"""Shard bounds, and files that are committed once whatever the attempts."""

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from sievework.llm import archive, shared, tokenout, warc


def weights(df, bounds):
    rows = df.select("n", "h").toArrow()
    return np.bincount(bounds.shard(rows["n"].to_numpy(), rows["h"].to_numpy()), minlength=bounds.shards)


def test_bounds_of_a_million_rows(spark, monkeypatch):
    monkeypatch.setattr(archive, "CELLS", 1 << 17)  # several ranges
    df = spark.range(1_000_000).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("h"))
    bounds = archive.range_bounds(df, F.col("n"), F.col("h"), F.lit(1), 20)
    assert bounds.shards == 50_000 and weights(df, bounds).max() <= 20


@pytest.mark.parametrize("clumps", [600, 1000])
def test_bounds_of_clumps(spark, clumps):
    df = spark.range(clumps * 50).select((F.floor(F.col("id") / 50) * 10**12 + F.col("id") % 50 - 10**14).alias("n"), F.lit(0).cast("long").alias("h"))
    bounds = archive.range_bounds(df, F.col("n"), F.col("h"), F.lit(1), 100)
    found = weights(df, bounds)
    assert bounds.shards == clumps // 2 and found.max() <= 100
    again = archive.range_bounds(df.repartition(3), F.col("n"), F.col("h"), F.lit(1), 100)
    assert (again.packed == bounds.packed).all()


def test_one_number_goes_to_several_shards(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(tokenout.LAST)).otherwise(F.col("id")).alias("n"), F.xxhash64("id").alias("h"))
    bounds = archive.range_bounds(df, F.col("n"), F.col("h"), F.lit(1), 100)
    assert weights(df, bounds).max() <= 100 and bounds.shards == 30


def test_bounds_of_nothing_and_of_signs():
    none = archive.Bounds(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert none.shards == 1 and none.shard(np.array([5]), np.array([5])).tolist() == [0]
    b = archive.Bounds(np.array([-5, 0, 0, 7]), np.array([3, -2, 4, 0]))
    assert b.shard(np.array([-6, -5, -5, 0, 0, 0, 7, 9]), np.array([9, 2, 3, -3, -2, 5, -1, 0])).tolist() == [0, 0, 1, 1, 2, 3, 3, 4]


def test_tasks_hold_runs_of_shards(spark, monkeypatch):
    monkeypatch.setattr(archive, "TASKS", 4)
    df = spark.range(100).withColumnRenamed("id", "shard").repartition(7)
    rows = archive.by_range(df, 100).select("shard", F.spark_partition_id().alias("t")).collect()
    assert {r.t for r in rows} == {0, 1, 2, 3} and all(r.t == r.shard * 4 // 100 for r in rows)


def test_commit_counts_one_attempt(spark):
    folder = shared.fresh_path(spark, "commit")
    lost, kept = (archive.TemporaryFile(folder, "a.bin", 0, 0) for _ in range(2))
    lost.write(b"half")
    lost.stream.close()
    kept.write(b"whole")
    row = kept.close()
    manifest = shared.materialize(spark.createDataFrame([row], archive.MANIFEST), "manifest")
    for _ in range(2):  # a commit that is repeated changes nothing
        done = archive.commit(manifest, folder)
    fs, base = archive.filesystem(folder)
    assert fs.open_input_stream(f"{base}/a.bin", compression=None).read() == b"whole"
    assert done.select("bytes").first()[0] == 5 and fs.get_file_info(f"{base}/_temporary").type == pafs.FileType.NotFound


def test_files_roll_by_compressed_size(spark):
    noise = np.random.default_rng(0).integers(33, 126, (60, 3000), np.uint8)
    df = spark.createDataFrame([(k, None, bytes(x).decode()) for k, x in enumerate(noise)], "page_id long, url string, html string")
    manifest, shards = warc.write(df, shared.fresh_path(spark, "roll"), shard_bytes=100_000, roll_bytes=20_000)
    files = manifest.orderBy("shard", "part").collect()
    assert shards > 1 and len(files) > 3 * shards and all(f.bytes < 20_000 + 4_000 for f in files)
