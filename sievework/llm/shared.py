"""Helpers of the training-text operators: shared tables, safe joins, views of Arrow text."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ship_package

#: A side of a join is broadcast only when its written files hold no more than this.
BROADCAST_BYTES = 8 << 20
#: A batch of texts for a Python worker; a longer text is a batch alone.
BATCH_BYTES = "2m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ready(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the Arrow batches that hold whole texts by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and driver and
    executors are one process, as in tests, a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {master} has no common disk")
        base = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def tidy() -> None:
    """Give a task's freed memory back: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


#: Paths of tables written inside each open scratch().
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize() writes inside are deleted at the end, but for those passed to the yielded function.

    What leaves the block must be such a table, or not depend on the others.
    """
    mine: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._shared_path)
        return df

    _SCOPES.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            if path not in kept:
                delete_path(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append(path)
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that nothing refers to any more; it acts when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and the size is known."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """df with a column name that numbers its rows, the same however often df is read.

    A table of Parquet files as they are is numbered by file and place in it. Any other df is written first.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in map(str.lower, df.columns):
        path, place, file = (unused_name(df, c) for c in ("path_", "place_", "file_"))
        try:
            placed = df.withColumns({path: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
        except AnalysisException:  # files of a kind without places
            placed = None
        if placed is not None:
            files = sorted(r[0] for r in placed.select(path).distinct().collect())  # no more than the scan itself lists
            known = spark.createDataFrame([(f, k) for k, f in enumerate(files)], StructType.fromDDL(f"{path} string, {file} long"))
            known = F.broadcast(known) if sum(map(len, files)) <= BROADCAST_BYTES else known
            number = F.shiftleft(file, 40) + F.col(place)
            return placed.join(known, path).select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a materialized table."""
    spark = df.sparkSession
    jvm, path = spark.sparkContext._jvm, df._shared_path
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialized table whose measured size is within limit; else leave the
    choice to the planner, whose sort-merge join splits skewed partitions."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application's operators left in the shared folder."""
    delete_path(spark, work_dir(spark))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() is the same, and faster, where every character is one byte."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_key(kind, ddl: str, name: str = "k") -> StructType:
    """A schema: the key, of whatever type, then the columns of ddl."""
    return StructType([StructField(name, kind), *StructType.fromDDL(ddl).fields])


def unused_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def utf8_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string column, nulls as empty, and the offsets of the rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of rows of about limit bytes; a longer row makes a run alone."""
    out, lo, n = [], 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        out.append((lo, hi))
        lo = hi
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, made longer as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            fill = np.full(size, self.base, np.uint64)
            fill[0] = 1
            self.up = np.multiply.accumulate(fill)
            fill[1:] = self.inverse
            self.down = np.multiply.accumulate(fill)
        return self.up[:n], self.down[:n]


BYTE_KEYS = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes; spans are compared with span_hash."""
    up, _ = _BYTES.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = _BYTES.upto(len(prefix))
    return mix64((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def gram_prefix(words: np.ndarray) -> np.ndarray:
    up, _ = _WORDS.upto(len(words) + 1)
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=out[1:])
    return out


def gram_hash(prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    _, down = _WORDS.upto(len(prefix))
    return mix64((prefix[at + n] - prefix[at]) * down[at] + np.uint64(n))


def word_bounds(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses a row's bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < n]
    start[first] = inside[first]
    end = np.zeros(n + 1, bool)
    end[1:n] = inside[:-1] & ~inside[1:]
    end[n] = inside[-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    end[cut] |= inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end)
