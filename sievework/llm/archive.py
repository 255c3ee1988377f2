"""Files written from tasks: temporary names, a manifest that counts one attempt of each task, then renames.

A task writes under `<folder>/_temporary` with a name of its own and reports a manifest row. The rows are
kept by Spark's own commit, so a repeated or lost attempt leaves no row. Only then are files renamed, in
tasks, to the names that the manifest gives; renaming again is harmless. Readers go by the manifest.
Shards are contiguous ranges of (key, tie) with bounds that depend on the data only. A task writes a run of
shards, so the number of tasks does not grow without end.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MANIFEST = "shard int, part int, name string, temporary string, bytes long, records long, items long, sha256 string"
#: Distinct (key, tie) that one task sums, and the most tasks that write.
CELLS, TASKS = 1 << 20, 1 << 15
#: The most shards; beyond them shards grow, so that their bounds, 16 bytes each, stay within 8 MB.
SHARDS = 1 << 19


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Bounds:
    """Ascending (key, tie) at which a new shard begins; before the first lies shard 0."""

    def __init__(self, keys: np.ndarray, ties: np.ndarray):
        self.packed = _packed(keys, ties)

    def shard(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.packed, _packed(keys, ties), "right").astype(np.int32)

    @property
    def shards(self) -> int:
        return len(self.packed) + 1


def _packed(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16 bytes each that compare as the pairs do."""
    pairs = np.stack([np.asarray(keys, np.int64), np.asarray(ties, np.int64)], 1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(pairs.astype(">u8")).view("S16").ravel()


def range_bounds(df: DataFrame, key: Column, tie: Column, weight: Column, target: int) -> Bounds:
    """Bounds of shards that weigh about target: at most target and one (key, tie) more.

    Weights are summed by (key, tie), sorted by range and summed up from the least; a shard begins where the
    sum passes a multiple of target. So bounds depend on the rows alone, whatever their number and however
    keys clump, and rows of one key with different ties can go to different shards. Only bounds reach the
    driver, and a number for each CELLS distinct (key, tie).
    """
    cells = df.select(key.cast("long").alias("n"), tie.cast("long").alias("h"), weight.cast("long").alias("w")).groupBy("n", "h").agg(F.sum("w").alias("w"))
    cells = shared.materialize(cells, "bounds-cells")
    count, total = cells.agg(F.count("*"), F.sum("w")).first()
    if not total:
        return Bounds(np.zeros(0, np.int64), np.zeros(0, np.int64))
    target = max(target, -(-total // SHARDS))
    # written once, so that every use sees the same cut into ranges
    ranged = shared.materialize(cells.repartitionByRange(-(-count // CELLS), "n", "h").withColumn("p", F.spark_partition_id()), "bounds-ranged")
    sums = dict(ranged.groupBy("p").agg(F.sum("w")).collect())  # a row for each CELLS cells
    order, before, base = sorted(sums), 0, []
    for p in order:
        base.append((p, before))
        before += sums[p]
    bases = df.sparkSession.createDataFrame(base, "p int, base long")
    run = F.sum("w").over(Window.partitionBy("p").orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1))
    begun = ranged.join(F.broadcast(bases), "p").select("n", "h", F.floor((F.col("base") + F.coalesce(run, F.lit(0))) / F.lit(target)).cast("long").alias("s"))
    first = begun.groupBy("s").agg(F.min(F.struct("n", "h")).alias("x")).orderBy("s").select("x.n", "x.h").toArrow()
    return Bounds(first["n"].to_numpy()[1:], first["h"].to_numpy()[1:])


def by_range(rows: DataFrame, shards: int, *order) -> DataFrame:
    """rows, with their column shard, in tasks of consecutive shards, each in order."""
    tasks = max(1, min(shards, TASKS))
    task = F.floor(F.col("shard").cast("long") * tasks / F.lit(max(1, shards))).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("shard", *order)


class TemporaryFile:
    """A file under a temporary name, with its size and digest as written."""

    def __init__(self, folder: str, name: str, shard: int, part: int):
        import hashlib

        self.fs, base = filesystem(folder)
        self.name, self.shard, self.part = name, shard, part
        self.temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(f"{base}/{self.temporary}", compression=None)
        self.bytes = self.records = self.items = 0
        self.sha = hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.stream.close()
        return (self.shard, self.part, self.name, self.temporary, self.bytes, self.records, self.items, self.sha.hexdigest())


def manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in MANIFEST.split(", ")])


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Rename the manifest's files in tasks, write the manifest beside them, and drop what is left over."""
    spark = manifest.sparkSession

    def work(batches):
        fs, base = filesystem(folder)
        for b in batches:
            for row in b.to_pylist():
                final, temporary = f"{base}/{row['name']}", f"{base}/{row['temporary']}"
                there = fs.get_file_info(final)
                if there.type != pafs.FileType.File or there.size != row["bytes"]:
                    fs.move(temporary, final)
                if fs.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{final} has not the {row['bytes']} bytes of its manifest")
            yield b

    manifest.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    shared.delete_path(spark, f"{folder}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
