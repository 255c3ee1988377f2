"""Extendible hashing: a directory of hash prefixes in which only buckets over a byte limit split.

DataFrame operations only. A row's hash is the first 60 bits of the MD5 of its key; a bucket is a prefix
of `depth` bits, and it splits on the next bit until its rows fit the limit. Rounds sum bytes by prefix,
several bits a round: a bucket that fits at some depth of the round is a leaf at the least such depth,
and only rows of buckets that do not fit go on to the next round. So one round is enough for most rows,
whatever the skew, and sums are made before they are shuffled.

Rows with equal hashes are told apart by a second hash of all the columns in `also`; what is equal in
these too cannot be separated by any hash and stays in one shard, whose shard_bytes then exceeds the
limit, as it does for a single row that is larger than the limit.

Cases: a null text has no bytes; a null key hashes as the empty string; repeated rows stay together; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LIMIT = 64 << 20
BITS, ROUND_BITS, FIRST_BITS = 60, 6, 16


def _hash(c):
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, column: str, base: int, upto: int, limit: int, last: bool) -> DataFrame:
    """(id_, node, depth, shard_bytes, shard_docs) for each node, a prefix of upto bits of column, that lies in
    a bucket which fits at base to upto bits; depth is the least that does. rows has id_ (the bucket of base bits they share), column, b_."""
    fine = rows.groupBy("id_", F.shiftright(column, BITS - upto).alias("node")).agg(F.sum("b_").alias("b"), F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    up = fine.select("id_", "node", "b", "n", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(upto))).alias("depth"))
    up = up.withColumn("p", F.expr(f"shiftright(node, {upto} - depth)"))
    whole = up.groupBy("id_", "depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # one row, or rows that the last hash cannot tell apart, is as small as a shard gets
    least = (F.col("shard_docs") == 1) | (F.lit(last) & (F.col("lo") == F.col("hi")))
    whole = whole.where((F.col("shard_bytes") <= limit) | least).drop("lo", "hi")
    # the second key lets the join exchange both sides, so that it can be split
    tag = F.col("p").bitwiseXOR(F.col("depth"))
    fits = up.select("id_", "node", "depth", "p").withColumn("t", tag).join(whole.withColumn("t", tag), ["id_", "depth", "p", "t"])
    return fits.groupBy("id_", "node").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("leaf")).select("id_", "node", "leaf.*")


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, doc_bytes, shard, depth, shard_bytes, shard_docs): one row for each of docs.

    shard is the prefix in binary; after 60 bits, a colon and the second hash's prefix.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    second = F.concat_ws("\x1f", name, *(F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in also))
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("k_"), _hash(name).alias("h_"), _hash(second).alias("g_"), size.alias("b_"), F.lit("").alias("id_"))
    rows = shared.materialize(rows, "shard-rows")
    total = rows.agg(F.sum("b_")).first()[0] or 0
    first = min(FIRST_BITS, max(3, math.ceil(math.log2(max(1, total / limit))) + 3))
    done = []
    for column in ("h_", "g_") if also else ("h_",):
        depth = 0
        while depth < BITS:
            upto = min(BITS, depth + (first if depth == 0 else ROUND_BITS))
            found = shared.materialize(directory(rows, column, depth, upto, limit, column == ("g_" if also else "h_")), "shard-directory")
            rows = rows.withColumn("node", F.shiftright(column, BITS - upto))
            bits = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright({column}, {BITS} - depth)), depth, '0') END")
            met = rows.join(found, ["id_", "node"])
            done.append(met.select("k_", "b_", F.concat("id_", bits).alias("shard"), (F.col("depth") + (BITS if column == "g_" else 0)).cast("int").alias("depth"), "shard_bytes", "shard_docs"))
            rows = rows.join(found.select("id_", "node"), ["id_", "node"], "left_anti").drop("node")
            depth = upto
            if rows.isEmpty():
                break
            rows = shared.materialize(rows, "shard-rows")
        else:
            # only rows that the first hash cannot tell apart come here
            rows = rows.withColumn("id_", F.concat("id_", F.lpad(F.bin(column), BITS, "0"), F.lit(":")))
            continue
        break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"k_": key, "b_": "doc_bytes"})


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write docs to one folder a shard; key must tell rows apart. Rows of a shard go to one task, which the
    limit bounds."""
    own = shared.unused_name(docs, "shard")
    docs.join(assigned.select(key, F.col("shard").alias(own)), key).repartition(own).write.partitionBy(own).parquet(folder)
