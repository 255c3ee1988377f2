"""Benchmark decontamination by winnowing, with DataFrame operations only.

From every window of SPAN consecutive words, the least hash of its k-grams of K words is kept, for the
benchmark and for the documents alike. A span of SPAN words that both hold has the same least hash on
both sides, so the join of kept hashes misses none. Hits are then extended: the window's words are
compared with the benchmark's windows, and neighbouring windows merge into spans. An item shorter than
SPAN words is one window and keeps the hash of all its words; documents keep such hashes of the lengths
that occur.

Documents are read once and are not shuffled. A document's words are cut into steps of STEP windows,
each with the SPAN + STEP - 1 words that its windows need, so that hashing runs in generated code. The
benchmark's hashes are broadcast in slices whose measured size is bounded, one pass over the documents a
slice; what is shuffled are hits.

Cases: null texts have no words; null item numbers count as ''; rows that share an item number are one
item; rows that share a document number are judged apart, and each gets its own result; an item without
words has no window; empty tables give an empty or a clean result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPAN, K = 10, 5
STEP = 6
#: Bytes of benchmark hashes that a pass broadcasts.
SLICE_BYTES = 8 << 20
BORDER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def steps(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, n (words), i (first word of the step), s (its words); a row without words has null i and s."""
    low = shared.ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    # with a border at both ends, the first and the last part are always empty
    split = rows.select(*keep, F.split(F.concat(F.lit(" "), low, F.lit(" ")), BORDER).alias("w"))
    sized = split.select(*keep, (F.size("w") - 2).alias("n"), "w")
    cut = f"CASE WHEN n > 0 THEN transform(sequence(0, n - 1, {STEP}), i -> struct(i AS i, slice(w, i + 2, least({SPAN + STEP - 1}, n - i)) AS s)) END"
    opened = sized.select(*keep, "n", F.explode_outer(F.expr(cut)).alias("x"))
    return opened.select(*keep, "n", "x.i", "x.s")


def hashes(step: DataFrame, keep: list[str], short: list[int]) -> DataFrame:
    """keep, n, i, s, p, v: the kept hash v of window p % STEP of the step; p // STEP counts SPAN and then short."""
    words = SPAN + STEP - 1
    one = step.select(*keep, "n", "i", "s", F.size("s").alias("c"), *(F.xxhash64(F.get("s", F.lit(j))).alias(f"w{j}") for j in range(words)))
    grams = [F.when(F.col("c") >= j + K, F.xxhash64(*(F.col(f"w{j + d}") for d in range(K)))).alias(f"g{j}") for j in range(words - K + 1)]
    two = one.select(*keep, "n", "i", "s", "c", *(f"w{j}" for j in range(words)), *grams)

    def least(j: int) -> Column:
        return F.when(F.col("c") >= j + SPAN, F.least(*(F.col(f"g{j + d}") for d in range(SPAN - K + 1))))

    kept = [least(j) for j in range(STEP)]
    for length in short:
        kept += [F.when(F.col("c") >= j + length, F.xxhash64(F.lit(length), *(F.col(f"w{j + d}") for d in range(length)))) for j in range(STEP)]
    return two.select(*keep, "n", "i", "s", F.posexplode(F.array(*kept)).alias("p", "v"))


def _window(short: list[int]) -> tuple[Column, Column]:
    """Start and words of the window of a row of hashes."""
    sizes = F.array(*[F.lit(x) for x in (SPAN, *short)])
    size = F.get(sizes, F.floor(F.col("p") / STEP).cast("int"))
    at = F.col("p") % STEP
    return size, F.array_join(F.slice("s", at + 1, size), " ")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items, spans, contaminated): one row for each of docs.

    spans are the hit windows as pairs of first word and word after the last; null if there are none.
    """
    items = shared.materialize(benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("t")), "benchmark-items")
    cut = shared.materialize(steps(items, "t", ["item"]), "benchmark-steps")
    short = sorted(r[0] for r in cut.where((F.col("n") > 0) & (F.col("n") < SPAN)).select("n").distinct().collect())  # fewer than SPAN values
    size, words = _window(short)
    found = hashes(cut, ["item"], short).where("v is not null").withColumns({"size": size, "win": words})
    found = found.where(F.col("size") == F.least("n", F.lit(SPAN)))
    windows = shared.materialize(found.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")), "benchmark-windows")
    marks = shared.materialize(found.select("v").distinct(), "benchmark-hashes")
    slices = max(1, -(-shared.stored_bytes(marks) // SLICE_BYTES))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    if slices > 1:  # the numbers must be the same in each pass
        rows = shared.materialize(rows, "decontam-rows")
    kept = hashes(steps(rows, "t", ["row", "k"]), ["row", "k"], short)
    first = (F.col("p") == 0) & (F.coalesce("i", F.lit(0)) == 0)
    told = None
    for part in range(slices):
        mine = marks.where(F.pmod("v", F.lit(slices)) == part).withColumn("hit", F.lit(True))
        pass_ = kept.join(F.broadcast(mine), "v", "left")
        pass_ = pass_.where(F.col("hit") | first) if part == 0 else pass_.where("hit")
        pass_ = pass_.select("row", "k", "n", (first & F.lit(part == 0)).alias("first"), F.coalesce("hit", F.lit(False)).alias("hit"), "i", "p", F.when(F.col("hit"), F.col("s")).alias("s"))
        told = pass_ if told is None else told.unionByName(pass_)
    told = shared.materialize(told, "decontam-hits")

    hits = told.where("hit").select("row", (F.col("i") + F.col("p") % STEP).alias("a"), size.alias("size"), words.alias("win"))
    met = hits.join(shared.broadcast_if_small(windows), "win")
    spans = met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", (F.col("a") + F.col("size")).alias("b")))).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("aggregate(x, struct(0L AS n, 0 AS e), (m, y) -> struct(m.n + greatest(0, y.b - greatest(y.a, m.e)) AS n, greatest(m.e, y.b) AS e), m -> m.n)")
    spans = spans.select("row", "x", "items", covered.alias("n_hit"))
    out = told.where("first").select("row", "k", "n").join(spans, "row", "left")
    none = F.expr("CAST(array() AS array<string>)")
    return out.select(
        F.col("k").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("x").alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
