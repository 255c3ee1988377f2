"""Dedup, exclusion and similarity joins.

Survivors are always chosen by an explicit order, so results do not depend on partitions. Exclusions are
left anti joins, one for each condition, never one join with OR.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from . import tables


def keep_first(df: DataFrame, key, order: str) -> DataFrame:
    """The row of least order of each key; what is needed is summed before it is shuffled."""
    best = df.groupBy(col(key).alias("key_")).agg(F.min_by(F.struct("*"), order).alias("row_"))
    return best.select("row_.*")


def cap_per_group(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= most).drop("rank_")


def suppress_across_sources(df: DataFrame, key: Column, rank: str) -> DataFrame:
    """Rows whose key occurs in a source of lower rank go; repeats inside one source stay."""
    keyed = df.withColumn("key_", key)
    least = keyed.groupBy("key_").agg(F.min(rank).alias("least_"))
    return keyed.join(least, "key_").where(F.col(rank) == F.col("least_")).drop("key_", "least_")


def exclude(df: DataFrame, key, held: DataFrame, held_key) -> DataFrame:
    """Rows whose key is in held go; null keys never match."""
    return df.withColumn("k_", col(key)).join(held.select(col(held_key).alias("k_")).where("k_ is not null").distinct(), "k_", "left_anti").drop("k_")


def leak_strengths(held: DataFrame, train: DataFrame) -> DataFrame:
    """held (id, a, b) with strengths: `pair` if one row of train (a, b) has both sides, else the sides found.

    Sides found in different rows count for each side; empty and null keys never match.
    """
    some = lambda c: train.select(c).where(f"{c} is not null and {c} <> ''").distinct().withColumn(f"has_{c}", F.lit(True))
    both = train.select("a", "b").where("a <> '' and b <> ''").distinct().withColumn("has_pair", F.lit(True))
    out = held.join(some("a"), "a", "left").join(some("b"), "b", "left").join(both, ["a", "b"], "left")
    pair = F.coalesce("has_pair", F.lit(False))
    return out.select("id", pair.alias("pair"), (~pair & F.coalesce("has_a", F.lit(False))).alias("side_a"), (~pair & F.coalesce("has_b", F.lit(False))).alias("side_b"))


def unique_key_join(sides: list[DataFrame], key: str) -> DataFrame:
    """Inner join of all sides on keys that occur once in each."""
    out = None
    for side in sides:
        once = side.join(side.groupBy(key).agg(F.count("*").alias("n_")).where("n_ = 1").select(key), key)
        out = once if out is None else out.join(once, key)
    return out


def rarest_tokens(tokens: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(id, token): the k tokens of least document frequency of each id; ties by token. tokens is distinct."""
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    if most is not None:
        df = df.where(F.col("df") <= most)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    return tokens.join(df, "token").withColumn("rank", rank).where(F.col("rank") <= k)


def candidate_pairs(train: DataFrame, held: DataFrame, train_k: int = 4, held_k: int = 8, most: int = 4000, top: int = 400) -> DataFrame:
    """(held_id, train_id, jaccard): for each held row its best training row among those that share rare tokens.

    train and held are (id, words) with distinct words; frequencies are those of train.
    """
    flat = train.select("id", F.explode("words").alias("token"))
    df = flat.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= most)

    def rare(rows: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
        return rows.join(df, "token").withColumn("r", rank).where(F.col("r") <= k).select("id", "token")

    meet = rare(held.select("id", F.explode("words").alias("token")), held_k).withColumnRenamed("id", "held_id")
    shared = meet.join(rare(flat, train_k).withColumnRenamed("id", "train_id"), "token").groupBy("held_id", "train_id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("held_id").orderBy(F.desc("shared"), "train_id"))
    near = shared.withColumn("r", rank).where(F.col("r") <= top)
    near = near.join(held.select(F.col("id").alias("held_id"), F.col("words").alias("a")), "held_id").join(train.select(F.col("id").alias("train_id"), F.col("words").alias("b")), "train_id")
    both = F.size(F.array_intersect("a", "b"))
    near = near.withColumn("jaccard", both / (F.size("a") + F.size("b") - both))
    best = F.row_number().over(Window.partitionBy("held_id").orderBy(F.desc("jaccard"), "train_id"))
    return near.withColumn("r", best).where("r = 1").select("held_id", "train_id", "jaccard")


#: Sets that the order of words comes from, and the words whose frequency is known; both change the cost only.
ORDER_SAMPLE, COMMON = 1 << 12, 1 << 13


def jaccard_join(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b of rows (id, words) with at least that similarity.

    Equal word sets are one point first, so copies do not multiply. A pair must share one of the
    n - ceil(least * n) + 1 first words of each side, in an order common to all: by hash, but those frequent in a
    sample last. Sizes, the places of the shared word and the parities of 256 classes of words (sets differ in at
    least as many words) must fit, before sets are compared. Only hashes of first words and, of points that are in
    such pairs, words are exchanged.
    """
    text = F.array_join(F.transform("words", lambda w: F.concat(F.length(w), F.lit(":"), w)), "")
    sets = rows.withColumn("words", F.array_sort("words")).withColumn("k", F.unhex(F.md5(text)))  # a filter by words would make them twice
    step = max(1, rows.count() // ORDER_SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select(F.explode("words").alias("w")).groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("c"))
    common = np.array([r.h for r in some.where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).collect()][::-1], np.int64)
    order = np.argsort(common)
    known = common[order]
    odd = ["b0", "b1", "b2", "b3"]

    def heads(batches):
        for batch in batches:
            hs = batch.column(2)
            flat, sizes = np.asarray(pc.list_flatten(hs)), np.asarray(pc.fill_null(pc.list_value_length(hs), 0)).astype(np.int64)
            row, rank = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, order[at] + 1, 0)
            flat = flat[np.lexsort((flat, rank, row))]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
            kept = place < first[row]
            bits = np.bincount(row * 256 + (flat & 255), minlength=256 * len(sizes)).reshape(-1, 256) & 1
            bits = np.packbits(bits.astype(bool), axis=1).view(np.int64)
            ends, wide = np.append(0, np.cumsum(sizes)), []
            unsorted = np.asarray(pc.list_flatten(hs))
            for i in range(0, len(sizes), 512):
                j = min(i + 512, len(sizes))
                one = np.bincount((row[ends[i] : ends[j]] - i) * 2048 + (unsorted[ends[i] : ends[j]] >> 8 & 2047), minlength=2048 * (j - i)) & 1
                wide.append(np.packbits(one.astype(bool)).view(np.int64))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * 32, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *wide])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(first, sizes))), pa.int32()), pa.array(flat[kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), lists, *(pa.array(bits[:, i].copy()) for i in range(4)), wide], ["k", "id", "n", "heads", *odd, "wide"])

    kind = rows.schema["id"].dataType.simpleString()
    hashed = sets.select("k", "id", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    slim = hashed.mapInArrow(heads, f"k binary, id {kind}, n long, heads array<long>, " + ", ".join(f"{c} long" for c in odd) + ", wide array<long>")
    points = slim.where("n > 0").groupBy("k").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "heads", *odd, "wide")))
    points = tables.written(points.withColumn("at", F.monotonically_increasing_id()), "jaccard-points")
    flat = points.select("at", "n", *odd, F.posexplode("heads").alias("p", "h"))
    x, y = flat.alias("x"), flat.alias("y")
    total, fewer = F.col("x.n") + F.col("y.n"), F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    apart = reduce(lambda u, v: u + v, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in odd))
    fits = (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9) & (fewer * (1 + least) >= least * total - 1e-9) & (apart * (1 + least) <= (1 - least) * total + 1e-9)
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.at") < F.col("y.at")) & fits).select(F.col("x.at").alias("a"), F.col("y.at").alias("b"))
    pairs = tables.written(pairs.distinct(), "jaccard-pairs")
    # and by the parities of 2,048 classes, which tell large sets apart too, before words are sent
    seen = lambda c: points.select(F.col("at").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    apart = F.aggregate(F.zip_with("wa", "wb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    pairs = pairs.join(seen("a"), "a").join(seen("b"), "b").where(apart * (1 + least) <= (1 - least) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")
    pairs = tables.written(pairs, "jaccard-near")
    nodes = pairs.select(F.col("a").alias("at")).union(pairs.select("b")).distinct()
    nodes = tables.written(points.select("at", "k", "id").join(nodes, "at"), "jaccard-nodes")
    some = tables.written(rows.join(tables.broadcast_if_small(nodes.select("id").distinct(), nodes), "id", "left_semi"), "jaccard-words")  # joined before words are made
    some = some.withColumn("words", F.array_sort("words")).select(F.unhex(F.md5(text)).alias("k"), "words")
    held = some.join(tables.broadcast_if_small(nodes.select("at", "k", "id"), nodes), "k").groupBy("at", "id").agg(F.first("words").alias("w"))
    held = tables.written(held, "jaccard-sets")
    side = lambda c: tables.broadcast_if_small(held.select(F.col("at").alias(c), F.col("id").alias(f"i{c}"), F.col("w").alias(f"w{c}")), held)
    meet = pairs.join(side("a"), "a").join(side("b"), "b").where("ia <> ib")
    both = F.size(F.array_intersect("wa", "wb")).alias("both")
    meet = tables.written(meet.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), both, (F.size("wa") + F.size("wb")).alias("n")), "jaccard-met")
    meet = meet.select("a", "b", (F.col("both") / (F.col("n") - F.col("both"))).alias("jaccard"))
    return meet.where(F.col("jaccard") >= least - 1e-12)


def multiset_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys with n_left and n_right, 0 where a side has none."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, keys, "full").na.fill(0, ["n_left", "n_right"])


def first_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The name of the first box, in their order, that holds a point; `other` if none. boxes is a short list."""
    inside = (F.col("lat") >= F.col("lat_lo")) & (F.col("lat") <= F.col("lat_hi")) & (F.col("lon") >= F.col("lon_lo")) & (F.col("lon") <= F.col("lon_hi"))
    met = points.join(F.broadcast(boxes), inside, "left")
    return met.groupBy("id").agg(F.coalesce(F.min_by("name", "rank"), F.lit("other")).alias("city"))


def breadth_first(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes of edges (parent, child) reached from roots, each at its least depth."""
    seen = roots.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    edge = seen
    for k in range(1, depth + 1):
        edge = edge.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(k).alias("depth")).distinct()
        edge = edge.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(edge)
    return seen


def balanced_bounds(position: Column, total: Column, shards: int) -> Column:
    """The shard of a row position from 0, in gap-free shards whose sizes differ by one at most."""
    size, extra = F.floor(total / shards), total % shards
    long = extra * (size + 1)
    return F.when(position < long, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - long) / F.greatest(size, F.lit(1)))).cast("long")


def greedy_budget(lengths: list[float], want: float, slack: float = 0.5) -> list[bool]:
    """Longest first: skip what would exceed want + slack, stop once want is reached."""
    taken, out = 0.0, []
    for x in lengths:
        ok = taken < want and taken + x <= want + slack
        taken += x if ok else 0.0
        out.append(ok)
    return out


def batches_within(widths: list[int], budget: int) -> list[int]:
    """Batch number of each item, in order: a batch's count times its widest item stays within budget."""
    out, number, count, widest = [], 0, 0, 0
    for w in widths:
        wide = max(widest, w)
        if count and (count + 1) * wide > budget:
            number, count, wide = number + 1, 0, w
        count, widest = count + 1, wide
        out.append(number)
    return out


def share_copies(extra: int, base: int, share: float) -> int:
    """How often base must be repeated to make up share beside extra; halves go to the even number."""
    return max(1, round(share * extra / ((1 - share) * base)))


def extra_for_rate(total: int, having: int, rate: float) -> int:
    """How many of the `having` rows must be added, in turn, so that they are rate of all."""
    return max(0, math.ceil(round((rate * total - having) / (1 - rate), 9))) if rate < 1 else 0
