"""Tables written in between: lineage ends there, and every use reads the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where it is unset and all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {master} has no common disk")
        base = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def is_small(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether the files of a written table are within limit."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df._written_path)
    return path.getFileSystem(sc.hadoopConfiguration()).getContentSummary(path).getLength() <= limit


def broadcast_if_small(df: DataFrame, of: DataFrame | None = None, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast of a written table, or of columns of one, whose files are within limit."""
    return F.broadcast(df) if is_small(df if of is None else of, limit) else df


def positions(df: DataFrame, order: str, rows_a_part: int = 1 << 20) -> DataFrame:
    """df with pos, its rows' positions from 0 in a total order, without one task for all rows.

    Rows are cut into ranges of the order and written with their range's number; a range is numbered inside,
    and moved by the sizes of those before, a number for each range. As the cut is written, both agree on it.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_part))
    ranged = written(df.repartitionByRange(parts, order).withColumn("part_", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("at_", F.row_number().over(Window.partitionBy("part_").orderBy(order)) - 1)
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.select("part_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    return inside.join(F.broadcast(before), "part_").withColumn("pos", (F.col("at_") + F.col("base_")).cast("long")).drop("part_", "at_", "base_")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of its component.

    Roots spread along edges and are then looked up themselves, so a round doubles their reach. Each round is written.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = written(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        seen = both.join(roots.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("r"))
        near = roots.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = written(near.join(jump, "root").select("node", "was", F.least("root", "far").alias("root")), "roots")
        moved = not now.where("was <> root").isEmpty()
        roots = now.select("node", "root")
        if not moved:
            return roots
