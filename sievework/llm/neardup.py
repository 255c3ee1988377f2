"""Near-duplicates by SimHash and by the Jaccard similarity of five-word shingles, 0.8 or more, exact.

SimHash proposes first: sets' fingerprints are searched by the vantage-point trees of simhash, and what these put
together is linked if the sets have the similarity. That finds the closer copies: at similarity 0.8 fingerprints
differ by about ten bits on average and by over twenty at times, where no distance bound is selective. So the
rest of the pairs, those of different components still, come from prefix
filtering: of two sets with similarity 0.8 or more, the first n - ceil(0.8 n) + 1 shingles of each, in any
order common to all, share one. Rare shingles come first by a sample's counts, so that passages that many
documents hold propose few pairs, and a shared shingle counts only if enough of both sets stands behind it.

Before that, most documents are told apart by their least hashes: of two such sets the first
n - ceil(0.8 n) + m in order of the hash share m, so a set goes on only if other sets hold as many of its first
hashes as its smallest partner would ask for. Hashes that a sample of the texts holds again and again are
known to be shared and are not sent around. The samples change the cost, never the result.

Equal sets are one point, whatever their number. Of those that share a shingle, each is compared with
the least and the greatest, then, where many share it, in a few rounds with some neighbours in a random order,
and at last with all that are of other components still: by then these are few, so a group of near copies does not cost the square
of its size. Shingles that very many points share are cut into parts, each compared with each, so no task
holds a whole group. Sets are of 64-bit hashes.

Cases: words are split and lower-cased as in simhash; up to five words make one shingle; null and wordless
texts have the empty set and are equal, and the one that stays of them goes too if another row of its number
has words; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, simhash

SHINGLE, SEED = 5, 42
#: Bits within which fingerprints are searched: a cost, never the result, as prefix filtering finds what lies further apart.
RADIUS = 8
#: Similarity as a fraction, so that bounds are whole numbers.
OVER, UNDER = 4, 5
#: Texts whose shingles are counted, sets that the order goes by, and the most shingles that are known as common.
SAMPLE, ORDER_SAMPLE, COMMON = 1 << 14, 1 << 12, 1 << 16
#: Rounds of random neighbours, for shingles that over MANY points share, and the points of one that a task
#: compares at once.
ROUNDS, MANY, PART = 3, 32, 1 << 13
#: The neighbours that a round compares a point with: so many places before it.
NEAR = (1, 2, 4, 7)
#: Columns of a set's parities: of 256 classes of hashes, whether it holds an odd number. Sets differ in at least
#: as many shingles as in parities, which rules pairs out exactly.
ODD = ["b0", "b1", "b2", "b3"]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[SHINGLE - 1 :]
    found = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
    return np.unique(found.view(np.int64))


def _sets(texts: pa.Array) -> list[np.ndarray]:
    data, offs = shared.utf8_view(texts)
    raw = data.tobytes()
    return [shingles(raw[i:j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offs, np.concatenate([np.zeros(0, np.int64), *parts]))


def _heads(n: np.ndarray) -> np.ndarray:
    """How many least hashes of a set of n are looked at."""
    return np.where(n > 0, n + (-OVER * n // UNDER) + n // 20 + 1, 0)


#: How many of them must be shared: what a partner of the least size would ask for.
ENOUGH = f"c >= ({OVER} * n + {UNDER - 1}) div {UNDER} div 20 + 1"


def _common(rows: DataFrame, text: str, count: int) -> np.ndarray:
    """Sorted hashes among the first ones of at least three different texts of a sample."""
    mark = F.xxhash64("t")
    some = rows.select(F.col(text).cast("string").alias("t")).where(F.pmod(mark, F.lit(max(1, count // SAMPLE))) == 0).groupBy(mark.alias("m")).agg(F.min("t").alias("t"))

    def work(batches):
        for b in batches:
            sets = {s.tobytes(): s for s in _sets(b.column(0))}.values()
            heads = [s[: int(_heads(np.array(len(s))))] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *heads]))], ["h"])
        shared.tidy()

    counted = some.select("t").mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2")
    return np.sort(np.array([r.h for r in counted.orderBy(F.desc("c"), "h").limit(COMMON).collect()], np.int64))


def _inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def first_hashes(rows: DataFrame, text: str, key: str, common: np.ndarray) -> DataFrame:
    """(k, d, n, c, heads) for each row: its set's digest and size, the common ones of its first hashes, the others."""
    slim = rows.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def work(batches):
        for b in batches:
            sets = _sets(b.column(1))
            size = np.array([len(s) for s in sets], np.int64)
            digest = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            heads = [s[:m] for s, m in zip(sets, _heads(size).tolist())]
            known = [_inside(common, x) for x in heads]
            held = pa.array(np.array([int(x.sum()) for x in known], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest), pa.array(size), held, _lists([x[~y] for x, y in zip(heads, known)])], ["k", "d", "n", "c", "heads"])
        shared.tidy()

    return slim.mapInArrow(work, shared.with_key(rows.schema[key].dataType, "d long, n long, c long, heads array<long>"))


def _held(rows: DataFrame, parts: int) -> DataFrame:
    """(d) once for each row of (h, d) whose h another row has too. A task sees its rows one batch at a time."""

    def work(batches):
        last = np.zeros((2, 0), np.int64)  # the row before, and whether it is to be told
        told = True
        for b in batches:
            x = np.concatenate([last, np.stack([np.asarray(b.column(c), np.int64) for c in ("h", "d")])], 1)
            same = x[0, 1:] == x[0, :-1]
            hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last.shape[1] and told:
                hit[0] = False
            last, told = x[:, -1:], bool(hit[-1]) or (told and x.shape[1] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[1, hit])], ["d"])
        shared.tidy()

    return rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(work, "d long")


def _likely(all_: DataFrame, heads: DataFrame) -> DataFrame:
    """(k, d) of those sets, each once, that can have a partner. heads has the first hashes of all_'s rows."""
    spark = all_.sparkSession
    again = shared.materialize(all_.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("m")).where("m > 1").select("d", "first"), "neardup-again")
    each = lambda df: df.where("n > 0").join(shared.broadcast_if_small(again), "d", "left").where("first is null or first = k")
    once = each(all_)
    total = once.agg(F.expr(f"coalesce(sum(n - ({OVER} * n + {UNDER - 1}) div {UNDER} + n div 20 + 1 - c), 0)")).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, total // 500_000 + 1)
    held = _held(each(heads).select(F.explode("heads").alias("h"), "d"), parts).select("d", F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("c"), F.lit(None).cast(all_.schema["k"].dataType).alias("k"))
    counted = held.unionByName(once.select("d", "n", "c", "k")).groupBy("d").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.max("k").alias("k"))
    return shared.materialize(counted.where(ENOUGH).select("k", "d"), "neardup-likely")


def _full(rows: DataFrame, text: str, key: str, likely: DataFrame) -> DataFrame:
    """(d, fp, n, hs): the whole sets of the rows in likely, and their fingerprints."""
    slim = rows.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(shared.broadcast_if_small(likely), "k").select("d", "t")

    def work(batches):
        for b in batches:
            sets = _sets(b.column(1))
            fps = np.array([simhash.of_hashes(s[i : i + simhash.PART] for i in range(0, len(s), simhash.PART)) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(np.array([len(s) for s in sets], np.int64)), _lists(sets)], ["d", "fp", "n", "hs"])
        shared.tidy()

    return shared.materialize(slim.mapInArrow(work, "d long, fp long, n long, hs array<long>"), "neardup-sets")


def _proposed(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) by SimHash: sets of one fingerprint with the least, and those with the points that the trees link them to."""
    points = shared.materialize(sets.groupBy("fp").agg(F.min("d").alias("first")), "neardup-points")
    small = shared.stored_bytes(points) <= shared.BROADCAST_BYTES

    def met(rows, key, name):
        side = points.select(F.col("fp").alias(key), F.col("first").alias(name))
        return rows.join(F.broadcast(side), key) if small else _tagged(rows, key).join(_tagged(side, key), [key, "tag"]).drop("tag")

    same = met(sets.select("fp", "d"), "fp", "e").select("d", "e")
    near = met(met(simhash.links(points.select("fp"), points.count(), RADIUS), "fp", "d"), "root", "e").select("d", "e")
    return same.unionAll(near).where("d <> e").select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that roots does not join yet."""
    small = shared.stored_bytes(roots) <= shared.BROADCAST_BYTES
    for c in ("a", "b"):
        side = roots.select(F.col("d").alias(c), F.col("root").alias(f"r{c}"))
        pairs = pairs.join(F.broadcast(side) if small else side, c, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(h, d, n, p) and ODD: the first shingles of each set and their places. Those of common (sorted by count) come last, in its order."""
    order = np.argsort(common)
    known = common[order]

    def work(batches):
        for b in batches:
            hs, heads, sizes, odd = b.column(2), [], [], []
            flat, offs = hs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(hs.value_lengths().to_numpy())])
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                one = flat[lo:hi]
                odd.append(np.packbits((np.bincount(one & 255, minlength=256) & 1).astype(bool)).view(np.int64))
                if len(known) and len(one):
                    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    one = one[np.lexsort((one, np.where(known[at] == one, order[at] + 1, 0)))]
                heads.append(one[: len(one) + (-OVER * len(one) // UNDER) + 1])
                sizes.append(len(heads[-1]))
            if heads:
                d, n = (np.repeat(b.column(c).to_numpy(), sizes) for c in (0, 1))
                place = np.arange(len(d)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(d), pa.array(n), pa.array(place), *map(pa.array, np.repeat(np.stack(odd, 1), sizes, 1))], ["h", "d", "n", "p", *ODD])
        shared.tidy()

    return sets.select("d", "n", "hs").where("n > 0").mapInArrow(work, ", ".join(f"{c} long" for c in ["h", "d", "n", "p", *ODD]))


def _fit(n, p, m, q, least=F.least):
    """Whether sets of n and m that share no shingle before the places p and q can have the similarity."""
    return (UNDER * n >= OVER * m) & (UNDER * m >= OVER * n) & ((OVER + UNDER) * least(n - p, m - q) >= OVER * (n + m))


def _tagged(df: DataFrame, column: str) -> DataFrame:
    """A second join key, so that a side that is grouped by the first is exchanged again and skew can be split."""
    return df.withColumn("tag", F.col(column).bitwiseXOR(F.lit(1)))


def _neighbours(placed: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of each shingle's points near each other in a random order, of different roots."""
    many = F.floor(F.col("m") / F.lit(PART)) + 1
    order = F.xxhash64("d", F.lit(round_))
    dealt = placed.withColumns({"x": order, "salt": F.pmod(order, many)})
    order = Window.partitionBy("h", "salt").orderBy("x", "d")
    beside = F.array(*(F.lag(F.struct("root", "d", "n", "p"), k).over(order) for k in NEAR))
    fits = lambda o: o.isNotNull() & (F.col("root") != o["root"]) & _fit(F.col("n"), F.col("p"), o["n"], o["p"])
    pairs = dealt.withColumn("near", beside).select("d", F.explode(F.filter("near", fits)).alias("o"))
    return pairs.select(F.least("d", "o.d").alias("a"), F.greatest("d", "o.d").alias("b")).distinct()


def _across(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a shingle with different roots, in blocks of parts of the shingle's points."""
    mixed = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x < y").select("h", (F.floor(F.col("m") / F.lit(PART)) + 1).cast("long").alias("s"))
    left = _tagged(placed.drop("m"), "h").join(_tagged(mixed, "h"), ["h", "tag"]).withColumn("i", F.pmod(F.xxhash64("d"), F.col("s")))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    left = left.select("h", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "i", "root", "d", "n", "p", *ODD)
    columns = ["h", "u", "v", "i", "root", "d", "n", "p", *ODD]

    def told(x):
        u, v, i, root, d, n, p = x[1:8]
        odd = x[8:].view(np.uint64)
        left_, right = np.flatnonzero(i == u[0]), np.flatnonzero(i == v[0])
        for at in range(0, len(left_), 64):
            s = left_[at : at + 64]
            ok = (root[s, None] != root[right]) & _fit(n[s, None], p[s, None], n[right], p[right], np.minimum)
            if u[0] == v[0]:
                ok &= d[s, None] < d[right]
            a, b = (side[at] for side, at in zip((s, right), np.nonzero(ok)))
            apart = np.bitwise_count(odd[:, a] ^ odd[:, b]).sum(0, dtype=np.int64)
            like = (OVER + UNDER) * apart <= (UNDER - OVER) * (n[a] + n[b])
            if like.any():
                a, b = d[a[like]], d[b[like]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def work(batches):
        held = []
        for b in batches:
            x = np.stack([np.asarray(b.column(c), np.int64) for c in columns])
            cut = [0, *(np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(0)) + 1).tolist(), x.shape[1]]
            for i, j in zip(cut[:-1], cut[1:]):
                if held and (held[-1][:3, -1] != x[:3, i]).any():
                    yield from told(np.concatenate(held, 1))
                    held = []
                if j > i:
                    held.append(x[:, i:j])
        if held:
            yield from told(np.concatenate(held, 1))
        shared.tidy()

    return left.repartition("h", "u", "v").sortWithinPartitions("h", "u", "v").mapInArrow(work, "a long, b long").distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have the similarity."""
    pairs = shared.materialize(pairs, "neardup-pairs")
    nodes = shared.materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "d"), "neardup-nodes")
    some = sets.join(shared.broadcast_if_small(nodes), "d", "left_semi")
    if shared.stored_bytes(sets) <= shared.BROADCAST_BYTES:
        some = F.broadcast(some)
    side = lambda c: some.select(F.col("d").alias(c), F.col("hs").alias(f"h{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    links = shared.materialize(met.where(UNDER * both >= OVER * (F.size("ha") + F.size("hb") - both)).select("a", "b"), "neardup-links")
    shared.sweep(sets.sparkSession)
    return links


def _joined(edges: DataFrame) -> DataFrame:
    """(d, root) of the nodes of edges (a, b)."""
    return _whole(simhash.connected(edges, "neardup-edges").select(F.col("node").alias("d"), "root"))


def _roots(sets: DataFrame) -> DataFrame:
    """(d, root) of the points that are linked with others."""
    roots = _joined(_alike(_proposed(sets), sets))
    count = sets.count()
    sample = sets.where(F.pmod(F.xxhash64("d"), F.lit(max(1, count // ORDER_SAMPLE))) == 0)
    counted = sample.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 2")
    common = np.array([r.h for r in counted.orderBy(F.desc("c"), "h").limit(COMMON).collect()][::-1], np.int64)
    heads = shared.materialize(_prefixes(sets, common), "neardup-prefixes")
    one = F.struct("d", "n", "p")
    ends = heads.groupBy("h").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count("*").alias("m")).where("m > 1")
    meet = shared.materialize(_tagged(heads, "h").join(_tagged(ends, "h"), ["h", "tag"]).drop("tag"), "neardup-meet")
    shared.sweep(sets.sparkSession)
    first = meet.select("d", "n", "p", F.explode(F.array("lo", "hi")).alias("x")).where((F.col("d") != F.col("x.d")) & _fit(F.col("n"), F.col("p"), F.col("x.n"), F.col("x.p")))
    pairs = first.select(F.least("d", "x.d").alias("a"), F.greatest("d", "x.d").alias("b")).distinct()
    roots = _joined(_alike(_apart(pairs, roots), sets).unionByName(roots.select(F.col("d").alias("a"), F.col("root").alias("b"))))
    meet = meet.drop("lo", "hi")
    for step in range(ROUNDS + 1):
        last = step == ROUNDS
        placed = (meet if last else meet.where(F.col("m") > MANY)).join(shared.broadcast_if_small(roots), "d", "left").select("h", "m", F.coalesce("root", "d").alias("root"), "d", "n", "p", *ODD)
        more = _alike(_across(placed) if last else _neighbours(placed, step), sets)
        if more.isEmpty():
            if last:
                break
            continue
        roots = _joined(more.unionByName(roots.select(F.col("d").alias("a"), F.col("root").alias("b"))))
    return roots


def _whole(roots: DataFrame) -> DataFrame:
    """With the roots themselves."""
    return shared.materialize(roots.unionAll(roots.select(F.col("root").alias("d"), "root").distinct()).distinct(), "neardup-roots")


def copies(rows: DataFrame, text: str, key: str, order: str) -> DataFrame:
    """(key): rows but the one of least (order, key) of each component, null orders last; key is unique."""
    with shared.scratch(rows.sparkSession) as keep:
        return keep(shared.materialize(_gone(rows, text, key, order), "neardup-gone"))


def _gone(rows: DataFrame, text: str, key: str, order: str) -> DataFrame:
    common = _common(rows, text, rows.count())
    heads = first_hashes(rows, text, key, common)
    # the hashes of all texts are not written: making them again takes less than their disk
    all_ = shared.materialize(heads.select("k", "d", "n", "c"), "neardup-all")
    likely = _likely(all_, heads)
    shared.sweep(rows.sparkSession)
    roots = _roots(_full(rows, text, key, likely))
    named = all_.select("k", "d", "n").join(shared.broadcast_if_small(roots), "d", "left").select("k", F.coalesce("root", "d").alias("c"), (F.col("n") > 0).alias("worded"))
    ranked = shared.materialize(named.join(rows.select(F.col(key).alias("k"), F.col(order).alias("o")), "k"), "neardup-rows")
    least = F.min(F.struct(F.col("o").isNull().alias("u"), "o", "k")).alias("x")
    first = ranked.groupBy("c").agg(F.count("*").alias("n"), least).where("n > 1")
    first = shared.materialize(first.select("c", F.col("x.k").alias("first")), "neardup-first")
    tag = lambda df: df.withColumn("t", F.col("c").bitwiseXOR(F.lit(1)))
    gone = tag(ranked).join(tag(first) if shared.stored_bytes(first) > shared.BROADCAST_BYTES else F.broadcast(tag(first)), ["c", "t"]).where("k <> first").select(F.col("k").alias(key))
    bare = ranked.where("not worded").agg(least).select("x.o", "x.k")  # one row
    named = ranked.where("worded").join(F.broadcast(bare.withColumnRenamed("k", "bare")), "o").select(F.col("bare").alias(key)).distinct()
    return gone.unionByName(named)
