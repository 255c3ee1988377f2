"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance.

Fingerprints are cut into shards by vantage-point trees: a node halves its points by their Hamming distance
from a vantage point, and a leaf is a shard. Every fingerprint lies in one shard of a tree, and is sent as a
query to the shards that the triangle bound cannot rule out: where its distance from a vantage point is
within the search radius of the cut, both sides are visited. Inside a shard another such tree, of all its
points, finds exact pairs.

Over all 64 bits random fingerprints lie within 4 of the cut at two levels of three, so nearly everything
would be sent everywhere. But a pair within 4 bits is within 1 bit over some third of the bits: so there
are three trees, each over the distances of a third, searched with radius 1, where a query meets both
sides at one level of three. Whatever a tree proposes is compared over all bits. In general radius // 2 + 1
trees search with radius 1.

Vantage points come from a sample of at most about SAMPLE fingerprints, which changes the cost, never the
result. A pair of different shards is sought once, in the later shard. Exact copies share a fingerprint and
are one point, whatever their number; dense balls are merged first; a shard that is larger than SHARD is cut
into parts, each of which goes to the parts after it. A shard returns a star for each of its components,
never all pairs of a group; stars meet in a distributed component search.

Cases: null and wordless texts have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; null keys take part and get their component's least key (null if it has none);
repeated rows stay, each with its component; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vptree

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that vantage points are chosen from, and the most that one task holds of a shard.
SAMPLE, SHARD = 1 << 16, 1 << 20
#: The most tasks, and the edges that one task joins by itself.
TASKS, LOCAL = 1 << 15, 1 << 16
PART = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the shingles' XXH64 hashes, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and [\x20\x09-\x0D] only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[shingle - 1 :]
    total = len(ends)
    return of_hashes(np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : min(a + PART, total)].tolist(), ends[a : a + PART].tolist())], "<u8") for a in range(0, total, PART))


def of_hashes(parts) -> int:
    """The fingerprint of shingles' hashes, which come in parts; 0 if there are none."""
    total, counts = 0, np.zeros(64, np.int64)
    for h in parts:
        total += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row (key, fp) for each of docs; fp is the fingerprint as a signed long."""
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def work(batches):
        for b in batches:
            data, offs = shared.utf8_view(b.column(1))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[i:j], shingle) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["k", "fp"])
        shared.tidy()

    return slim.mapInArrow(work, shared.with_key(docs.schema[key].dataType, "fp long")).withColumnRenamed("k", key)


def masks(radius: int = RADIUS) -> list[int]:
    """The bits of each tree: a pair within radius is within 1 over some of these."""
    m = radius // 2 + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]


def _placed(points: DataFrame, trees: list[vptree.Tree], parts: dict[int, int] | None) -> DataFrame:
    """(shard, home, fp): each point's shard of each tree and the later ones that it is a query of.

    parts has the number of parts of each shard and the number of its first; without it only homes are given.
    """
    first = np.cumsum([0] + [len(t.members) for t in trees])

    def work(batches):
        for b in batches:
            fp = np.asarray(b.column(0), np.int64)
            own = fp.view(np.uint64)
            salt = shared.mix64(own)
            out = []
            for tree, base in zip(trees, first.tolist()):
                homes = tree.homes(own)
                if parts is None:
                    out.append((homes + base, np.ones(len(fp), bool), fp))
                    continue
                for leaf, who in tree.visits(own):
                    who = who[homes[who] <= leaf]
                    at, count = parts.get(base + leaf, (0, 0))
                    mine = (salt[who] % np.uint64(max(1, count))).astype(np.int64)
                    for part in range(count):
                        here = (homes[who] < leaf) | (mine <= part)
                        go = who[here]
                        out.append((np.full(len(go), at + part), (homes[go] == leaf) & (mine[here] == part), fp[go]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                for a in range(0, len(cols[0]), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in cols], ["shard", "home", "fp"])
        shared.tidy()

    return points.select("fp").mapInArrow(work, "shard long, home boolean, fp long")


def links(points: DataFrame, count: int, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Stars (fp, root) of each shard's components and of what visits them; points has distinct fp."""
    spark = points.sparkSession
    some = points.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, count // sample))) == 0).select("fp").toArrow()["fp"].to_numpy().astype(np.int64)
    some = np.sort(some.view(np.uint64))
    shards = max(spark.sparkContext.defaultParallelism, -(-2 * count // shard))
    trees = [vptree.Tree(some, m, 1, max(1, len(some) // shards), k) for k, m in enumerate(masks(radius))]
    sizes = dict(_placed(points, trees, None).groupBy("shard").agg(F.count("*")).collect())  # a row a shard
    parts, total = {}, 0
    for s in range(sum(len(t.members) for t in trees)):
        parts[s] = (total, max(1, -(-sizes.get(s, 0) // shard)))
        total += parts[s][1]
    which = np.repeat(np.arange(len(trees)), [sum(parts[s][1] for s in range(sum(len(t.members) for t in trees[:k]), sum(len(t.members) for t in trees[: k + 1]))) for k in range(len(trees))])
    bits = masks(radius)
    tasks = max(1, min(total, TASKS))
    rows = _placed(points, trees, parts)
    rows = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(max(1, total))).cast("int")).sortWithinPartitions("shard", F.desc("home"))

    def work(batches):
        own, shard, held = None, None, []
        for b in batches:
            at, home, fp = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2), np.int64).view(np.uint64)
            for i, j in _runs(at, home):
                if at[i] != shard:
                    if held:
                        yield from _home(vptree.Shard(np.concatenate(held), radius, bits[which[shard]], 1))
                    own, shard, held = None, int(at[i]), []
                if home[i]:
                    held.append(fp[i:j])
                    continue
                if held:
                    own, held = vptree.Shard(np.concatenate(held), radius, bits[which[shard]], 1), []
                    yield from _home(own)
                if own is not None:
                    met = own.visitors(fp[i:j])
                    yield from _star(fp[i:j][met[:, 0]], own.points[met[:, 1]])
        if held:
            yield from _home(vptree.Shard(np.concatenate(held), radius, bits[which[shard]], 1))
        shared.tidy()

    return rows.mapInArrow(work, "fp long, root long").distinct()


def _runs(at: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of one shard that are all homes, or all queries."""
    if not len(at):
        return []
    cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (home[1:] != home[:-1])) + 1).tolist(), len(at)]
    return list(zip(cuts[:-1], cuts[1:]))


def _star(fps: np.ndarray, roots: np.ndarray):
    if len(fps):
        yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(roots.view(np.int64))], ["fp", "root"])


def _home(own: vptree.Shard):
    moved = np.flatnonzero(own.label != np.arange(len(own.label)))
    yield from _star(own.points[moved], own.points[own.label[moved]])


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of its component.

    A task joins up to LOCAL edges by itself; if all fit into one, that is the result. Else stars alternate:
    every node hands its larger neighbours, then its smaller ones, to the least node it sees, until nothing
    moves. Each round is written, so a lost executor costs one round at most.
    """
    edges = shared.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        parts = -(-edges.count() // LOCAL)
        near = shared.materialize(edges.repartition(max(1, parts)).mapInArrow(_join_local, "a long, b long"), label)
        if parts <= 1:
            edges = near
            break
        both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _meet(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, low).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = shared.materialize(small.where("a <> b").distinct(), label)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _join_local(batches):
    """Stars (a, b) of the components of a task's edges."""
    ends = [np.stack([np.asarray(b.column(c), np.int64) for c in ("a", "b")]) for b in batches]
    if ends:
        both = np.concatenate(ends, 1)
        nodes, at = np.unique(both, return_inverse=True)
        at = at.reshape(both.shape)
        root = vptree.spread(np.arange(len(nodes)), at[0], at[1])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _meet(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with m by a. The second key makes both sides exchange, so that skewed nodes can be split."""
    tag = F.col("a").bitwiseXOR(F.lit(1))
    return edges.withColumn("t", tag).join(low.withColumn("t", tag), ["a", "t"])


def clusters(fps: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): for each distinct fp the least key of its component."""
    points = shared.materialize(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-points")
    stars = links(points.select("fp"), points.count(), radius)
    roots = connected(stars.select(F.col("fp").alias("a"), F.col("root").alias("b")), "simhash-edges")
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = placed.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.withColumn("t", F.col("root") + 0).join(least.withColumn("t", F.col("root") + 0), ["root", "t"]).select("fp", "component_id")
    alone = placed.where("root is null").select("fp", F.col("least").alias("component_id"))
    return shared.materialize(linked.unionByName(alone), "simhash-components")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) for each of docs."""
    fps = shared.materialize(fingerprints(docs, text, key, shingle), "simhash-fingerprints")
    found = clusters(fps, key, radius)
    return fps.join(found, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
