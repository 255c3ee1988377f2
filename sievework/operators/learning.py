"""Word statistics and small models: frequencies, association, naive Bayes, translation tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import col
from . import tables


def document_frequency(rows: DataFrame, group: str) -> DataFrame:
    """(group, token, df, tf, total): of rows (group, id, tokens)."""
    flat = rows.select(group, "id", F.explode("tokens").alias("token"))
    once = flat.groupBy(group, "token", "id").agg(F.count("*").alias("n")).groupBy(group, "token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    total = flat.groupBy(group).agg(F.count("*").alias("total"))
    return once.join(total, group)


def cooccurrence(pairs: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """(x, y, n): pairs whose arrays a and b hold x and y."""
    flat = pairs.select(F.explode(F.array_distinct(a)).alias("x"), F.col(b))
    return flat.select("x", F.explode(F.array_distinct(b)).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def association(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, n, seen_x, seen_y, assoc, dice)."""
    seen = lambda c, x: pairs.select(F.explode(F.array_distinct(c)).alias(x)).groupBy(x).agg(F.count("*").alias(f"seen_{x}"))
    met = cooccurrence(pairs, a, b).join(seen(a, "x"), "x").join(seen(b, "y"), "y")
    return met.withColumn("assoc", F.col("n") / F.col("seen_x")).withColumn("dice", 2 * F.col("n") / (F.col("seen_x") + F.col("seen_y")))


#: Characters that a task takes the grams of at once; a longer text is taken whole. Bits of a character in a gram's number.
CHARS, BITS = 1 << 18, 21
#: Values below this are counted in an array of all of them if it is not much longer than what is counted; else they are
#: sorted. Counts of a few keys that a task holds before it hands them on.
DENSE, HELD = 1 << 23, 1 << 20
#: Parts the texts that the grams of: a lone surrogate, which no text holds.
BREAK = "\ud800"


def _ranked(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of values below limit, in order, the place of each value among them, and their counts."""
    if limit > min(DENSE, 8 * len(values) + 1024):
        found, at, counts = np.unique(values, return_inverse=True, return_counts=True)
        return found, at, counts
    counts = np.bincount(values, minlength=limit)
    found = np.flatnonzero(counts)
    at = np.zeros(limit, np.int64)
    at[found] = np.arange(len(found))
    return found, at[values], counts[found]


def _key_grams(keys: np.ndarray, count: int, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, number, c) of all 1- to 3-grams of texts, whose keys are below count; each key and gram once.

    An empty text has one empty gram, 0, and a null none. Grams are numbered by the ranks of the characters and
    pairs that there are, so most are counted in arrays.
    """
    valid = np.asarray(pc.is_valid(texts))
    size = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
    chars = np.frombuffer((BREAK.join(pc.fill_null(texts, "").to_pylist()) + BREAK).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    own = np.repeat(keys, size + 1)
    chars[np.cumsum(size + 1) - 1] = 0
    empty, c = np.unique(keys[(size == 0) & valid], return_counts=True)
    out = [(empty, np.zeros(len(empty), np.int64), c)]
    letters, first, _ = _ranked(chars, int(chars.max()) + 1)
    numbers, whole, rank = letters, letters > 0, first
    for n in (1, 2, 3):
        if n > 1:
            found, rank, _ = _ranked(rank[:-1] * len(letters) + first[n - 1 :], len(numbers) * len(letters))
            before, last = np.divmod(found, len(letters))
            numbers, whole = numbers[before] << BITS | letters[last], whole[before] & (letters[last] > 0)
        at, _, c = _ranked(own[: len(rank)] * len(numbers) + rank, count * len(numbers))
        key, gram = np.divmod(at, max(1, len(numbers)))
        some = whole[gram]
        out.append((key[some], numbers[gram[some]], c[some]))
    return out


def _runs_of_texts(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows of about CHARS characters."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64))
    cuts, lo = [0], 0
    while lo < len(ends):
        lo = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARS, "right")))
        cuts.append(lo)
    return list(zip(cuts[:-1], cuts[1:]))


def _keyed_runs(batches):
    """(distinct keys, rows' keys among them, texts) of runs of rows of batches (key, text)."""
    for b in batches:
        for lo, hi in _runs_of_texts(b.column(1)):
            keys = b.column(0).slice(lo, hi - lo).dictionary_encode("encode")
            yield keys.dictionary, np.asarray(keys.indices).astype(np.int64), b.column(1).slice(lo, hi - lo)


def _summed(parts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """parts (key, number, c) as one, each key and number once."""
    key, number, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((number, key))
    key, number, c = key[order], number[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])]) if len(key) else np.zeros(0, bool))
    return [(key[starts], number[starts], np.add.reduceat(c, starts) if len(starts) else c)]


def _lowered(rows: DataFrame, key: str, text) -> DataFrame:
    return rows.select(F.col(key), F.lower(col(text)).alias("text"))


def _gram_counts(rows: DataFrame, key: str, text, few: bool = False) -> DataFrame:
    """(key, number, c): each gram of lower-cased texts with its count, summed up in runs of rows of one task.

    With few keys a task adds runs up while that keeps what it holds small.
    """
    kind = rows.schema[key].dataType.simpleString()

    def told(names, parts):
        for own, number, c in parts:
            if len(own):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(number), pa.array(c)], ["key", "number", "c"])

    def work(batches):
        codes, held, size = {}, [], 0
        names = lambda kind_: pa.array(list(codes), kind_)
        for keys, own, texts in _keyed_runs(batches):
            parts = _key_grams(own, len(keys), texts)
            if not few:
                yield from told(keys, parts)
                continue
            code = np.array([codes.setdefault(k, len(codes)) for k in keys.to_pylist()], np.int64)
            held += [(code[k], number, c) for k, number, c in parts]
            size += sum(len(c) for _, _, c in parts)
            if size > HELD:
                held = _summed(held)
                size = len(held[0][2])
                if size > HELD // 2:
                    yield from told(names(keys.type), held)
                    codes, held, size = {}, [], 0
        if held:
            yield from told(names(keys.type), _summed(held))

    return _lowered(rows, key, text).mapInArrow(work, f"key {kind}, number long, c long")


def bayes_train(rows: DataFrame, label: str, text, least: int = 3) -> DataFrame:
    """(label, gram, n): character 1- to 3-grams of lower-cased text; longer ones only if counted `least` times.

    Grams are counted as numbers in Arrow batches, so that only counts are exchanged.
    """
    n = _gram_counts(rows, label, text, few=True).groupBy("key", "number").agg(F.sum("c").alias("n"))
    kind = rows.schema[label].dataType.simpleString()
    mask = (1 << BITS) - 1

    def spell(batches):
        for b in batches:
            grams = ["".join(chr(c - 1) for c in (x >> 2 * BITS, x >> BITS & mask, x & mask) if c) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.string()), b.column(2)], ["label", "gram", "n"])

    return n.where(F.col("number").between(1, mask) | (F.col("n") >= least)).mapInArrow(spell, f"label {kind}, gram string, n long")


def bayes_predict(rows: DataFrame, model: DataFrame, text, default: str) -> DataFrame:
    """(id, predicted): of rows with id; equal scores go to default, then to the first label."""
    model = tables.written(model, "bayes-model")
    total = model.groupBy("label").agg(F.sum("n").alias("total"))
    size = model.select("gram").distinct().agg(F.count("*").alias("v"))
    labels = tables.written(total.join(F.broadcast(size)), "bayes-labels")  # labels by one row
    at = lambda k: F.when(F.length("gram") >= k, F.ascii(F.substring("gram", k, 1)).cast("long") + 1)
    number = F.lit(0).cast("long")
    for k in (1, 2, 3):
        number = F.coalesce(F.shiftleft(number, BITS).bitwiseOR(at(k)), number)
    numbered = model.where("label IS NOT NULL").groupBy(number.alias("number")).agg(F.collect_list(F.struct("label", F.ln(F.col("n") + 1.0).alias("w"))).alias("ws"))
    numbered = tables.written(numbered, "bayes-numbers")
    if tables.is_small(numbered):
        gained = _gains(rows, numbered, labels, text)
    else:
        # a gram that a label lacks scores as one counted zero times, so only known grams are joined
        known = _gram_counts(rows, "id", text).join(numbered, "number").select(F.col("key").alias("id"), "c", F.explode("ws").alias("w"))
        gain = known.groupBy("id", F.col("w.label").alias("label")).agg(F.sum(F.col("c") * F.col("w.w")).alias("gain"))
        chars = F.length(F.lower(col(text)))
        length = rows.where(col(text).isNotNull()).groupBy("id").agg(F.sum(F.greatest(F.lit(1), chars, 2 * chars - 1, 3 * chars - 3)).alias("len"))
        gained = length.join(F.broadcast(labels)).join(gain, ["id", "label"], "left")
    scored = gained.withColumn("score", F.round(F.coalesce("gain", F.lit(0.0)) - F.col("len") * F.ln((F.col("total") + F.col("v")).cast("double")), 6))
    best = scored.groupBy("id").agg(F.max_by("label", F.struct("score", (F.col("label") == default).alias("d"))).alias("predicted"))
    return best


def _gains(rows: DataFrame, numbered: DataFrame, labels: DataFrame, text) -> DataFrame:
    """(id, len, gain, label, total, v): of rows' texts for each label, by a model that each task holds."""
    at = labels.select("label", "total", "v").withColumn("at", F.row_number().over(Window.orderBy("label")) - 1)
    at = tables.written(at, "bayes-places")  # a row a label
    places = {r["label"]: r["at"] for r in at.select("label", "at").collect()}
    model = numbered.orderBy("number").select("number", F.explode("ws").alias("w")).select("number", "w.label", "w.w").toArrow()
    grams, place = np.unique(model["number"].to_numpy(), return_inverse=True)
    weights = np.zeros((len(places), len(grams) + 1))  # the last for grams that are not known
    weights[[places[k] for k in model["label"].to_pylist()], place] = model["w"].to_numpy()
    held = rows.sparkSession.sparkContext.broadcast((grams, weights))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        grams, weights = held.value
        many = len(weights)
        for keys, own, texts in _keyed_runs(batches):
            size, gain = np.zeros(len(keys)), np.zeros((many, len(keys)))
            for key, number, c in _key_grams(own, len(keys), texts):
                spot = np.searchsorted(grams, number)
                spot[spot < len(grams)] = np.where(grams[spot[spot < len(grams)]] == number[spot < len(grams)], spot[spot < len(grams)], len(grams))
                size += np.bincount(key, c, len(keys))
                for k in range(many):
                    gain[k] += np.bincount(key, c * weights[k, spot], len(keys))
            there = np.flatnonzero(size)
            ids = keys.take(pa.array(np.repeat(there, many)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(size[there].astype(np.int64), many)), pa.array(gain[:, there].T.ravel()), pa.array(np.tile(np.arange(many), len(there)))], ["id", "len", "gain", "at"])

    told = _lowered(rows, "id", text).mapInArrow(work, f"id {kind}, len long, gain double, at long")
    return told.groupBy("id", "at").agg(F.sum("len").alias("len"), F.sum("gain").alias("gain")).join(F.broadcast(at), "at").drop("at")


#: Cells (word of a, word of b, pair) that a task of translation_table holds, about 100 bytes each while it sorts them.
CELLS = 1 << 22


def translation_table(pairs: DataFrame, a: str, b: str, rounds: int, least: int = 2) -> DataFrame:
    """(x, y, p): IBM model 1 by expectation maximisation over words that occur together `least` times.

    The expectation is taken for each token of b over the set of a. An expectation needs only its own y, so pairs
    are dealt to blocks of y's words, as arrays: a pair goes once to each block that has words of its b, and its
    cells are made, counted and weighed there. Between rounds only the sums of each x are sent; a block makes its
    earlier rounds again from them. All cells of one y are in one task.
    """
    slim = pairs.select("id", F.filter(F.array_distinct(a), lambda x: x.isNotNull()).alias("xs"), F.filter(F.col(b), lambda y: y.isNotNull()).alias("ys"))
    slim = tables.written(slim.where("size(xs) > 0 AND size(ys) > 0"), "pairs")
    spark = pairs.sparkSession
    cells = slim.agg(F.sum(F.size("xs").cast("long") * F.size("ys"))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-cells // CELLS))
    block = lambda y: F.pmod(F.xxhash64(y), F.lit(blocks)).cast("int")

    def deal(batches):
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
                number, ids, xs, ys = (b.column(c) for c in range(4))
                row = np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(ys)))
                key = row * blocks + np.asarray(pc.list_flatten(number)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.diff(key, prepend=-1))
                mine = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pc.list_flatten(ys).take(pa.array(order)))
                row = pa.array(row[order][start])
                yield pa.RecordBatch.from_arrays([pa.array(key[start] % blocks, pa.int32()), ids.take(row), xs.take(row), mine], ["block", "id", "xs", "ys"])

    kind = pairs.schema["id"].dataType.simpleString()
    dealt = slim.select(F.transform("ys", block).alias("b"), "id", "xs", "ys").mapInArrow(deal, f"block int, id {kind}, xs array<string>, ys array<string>")
    sums = spark.createDataFrame([], "block int, round int, x string, total double")
    for r in range(1, rounds + 1):
        part = _em_blocks(dealt, sums, r, least, False).select("block", "x", F.col("p").alias("c"))
        part = tables.written(part, "sums")
        total = part.groupBy("x").agg(F.sum("c").alias("total"))
        sums = sums.unionByName(part.join(total, "x").select("block", F.lit(r).alias("round"), "x", "total"))
        sums = tables.written(sums, "sums")
    return _em_blocks(dealt, sums, rounds, least, True).select("x", "y", "p")


def _em_blocks(dealt: DataFrame, sums: DataFrame, rounds: int, least: int, done: bool) -> DataFrame:
    """(block, x, y, p) of each block after some rounds: the last round's sums of each x, or if done p of at least 1e-4."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"block": pa.array([], pa.int32()), "x": pa.array([], pa.string()), "y": pa.array([], pa.string()), "p": pa.array([], pa.float64())})
        flat = lambda c: pc.list_flatten(left[c].combine_chunks()).dictionary_encode()
        size = lambda c: np.asarray(pc.list_value_length(left[c].combine_chunks())).astype(np.int64)
        ids = np.asarray(pc.fill_null(left["id"].combine_chunks().dictionary_encode().indices, -1)).astype(np.int64) + 1
        xs, ys, nx = flat("xs"), flat("ys"), size("xs")
        xi, width = np.asarray(xs.indices).astype(np.int64), len(ys.dictionary)
        # words of b, once a pair with their number
        key, mult = np.unique(np.repeat(np.arange(len(left)), size("ys")) * width + np.asarray(ys.indices), return_counts=True)
        row, y = key // width, key % width
        group = np.unique(ids[row] * width + y, return_inverse=True)[1]
        # cells: each of them with the words of a
        n = nx[row]
        at = np.repeat(np.arange(len(key)), n)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(n) - n - (np.cumsum(nx) - nx)[row], n)
        code, cell, count = np.unique(y[at] * len(xs.dictionary) + xi[cell], return_inverse=True, return_counts=True)
        kept = count >= least
        inside = kept[cell]
        at, cell, code = at[inside], (np.cumsum(kept) - 1)[cell[inside]], code[kept]
        x, y = code % len(xs.dictionary), code // len(xs.dictionary)
        group, mult = group[at], mult[at]
        p = np.ones(len(code))
        for r in range(1, rounds + 1):
            z = np.bincount(group, p[cell])
            p = np.bincount(cell, mult * p[cell] / z[group], len(code))
            if r < rounds or done:
                known = right.filter(pc.equal(right["round"], r))
                total = np.full(len(xs.dictionary), np.nan)
                total[np.asarray(pc.index_in(known["x"].combine_chunks(), xs.dictionary))] = np.asarray(known["total"])
                p = p / total[x]
        if done:
            some = p >= 1e-4
            x, y, p = x[some], y[some], p[some]
        else:
            p = np.bincount(x, p, len(xs.dictionary))
            x, y = np.unique(x), None
            p = p[x]
        y = pa.nulls(len(x), pa.string()) if y is None else ys.dictionary.take(pa.array(y))
        return pa.table({"block": pa.array(np.full(len(x), left["block"][0].as_py(), np.int32)), "x": xs.dictionary.take(pa.array(x)), "y": y, "p": pa.array(p, pa.float64())})

    return dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(work, "block int, x string, y string, p double")


def akin(a, b):
    """Two forms near enough to be one word: five shared first letters, or one is the other and a letter."""
    short, gap = F.least(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    prefix = (short >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5)) & (gap <= 3)
    return (a == b) | prefix | ((short >= 3) & (gap <= 1) & (F.startswith(a, b) | F.startswith(b, a)))


def contrasts(assoc: DataFrame, least: int, share: float, dice: float) -> DataFrame:
    """(x, y, n, dice, verdict): each x with its best y; refused if the best x of that y is another word.

    assoc comes from association(). The best has the greatest Dice, then share of the word's rows, then the
    least edit distance, then the first text. A y without a best x is no evidence against a pair.
    """
    pairs = assoc.where(F.col("n") >= least).where(F.col("dice") >= dice)
    rank = lambda s, other: F.struct(-F.round("dice", 9), -F.round(s, 9), F.levenshtein("x", "y"), other)
    there, back = F.col("n") / F.col("seen_x"), F.col("n") / F.col("seen_y")
    one = pairs.where(there >= share).groupBy("x").agg(F.min_by(F.struct("y", "n", "dice"), rank(there, "y")).alias("best")).select("x", "best.*")
    two = pairs.where(back >= share).groupBy("y").agg(F.min_by("x", rank(back, "x")).alias("bx"))
    differs = F.col("bx").isNotNull() & ~akin(F.col("bx"), F.col("x"))
    return one.join(two, "y", "left").select("x", "y", "n", "dice", F.when(differs, "reverse differs").otherwise("admitted").alias("verdict"))


def families(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, other): a form joins the first root, by length and alphabet, with its five first
    letters, at most three letters shorter, whose counterpart has the same four first letters. Words of one
    prefix are one bounded group."""

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, found = [], []
        for word, other in sorted(zip(pdf["word"], pdf["other"]), key=lambda f: (len(f[0]), f[0])):
            root = next((r for r, o in roots if len(r) >= 5 and len(word) - len(r) <= 3 and o[:4] == other[:4]), None)
            if root is None:
                roots.append((word, other))
            found.append((word, root or word))
        return pd.DataFrame(found, columns=["word", "root"])

    return forms.dropDuplicates(["word"]).groupBy(F.substring("word", 1, 5).alias("prefix_")).applyInPandas(grouped, "word string, root string")


def coverage(pairs: DataFrame, a: str, b: str, table: DataFrame, frequent: int = 50, least: int = 5, sure: float = 0.02) -> DataFrame:
    """(id, scoreable, coverage): the share of b's frequent words that a holds, itself or by table (x, y, p).

    Pairs with under `least` scoreable words have a null coverage; pairs with none are absent. Words of a are
    joined with the table, so the sides are never multiplied.
    """
    asked = pairs.select("id", F.explode(F.array_distinct(b)).alias("y"))
    known = asked.groupBy("y").agg(F.count("*").alias("n")).where(F.col("n") >= frequent).select("y")
    words = pairs.select("id", F.explode(F.array_distinct(a)).alias("x"))
    named = words.join(table.where(F.col("p") >= sure).join(known, "y", "left_semi").select("x", "y"), "x").select("id", "y")
    given = named.unionByName(words.withColumnRenamed("x", "y")).distinct().withColumn("held", F.lit(1.0))
    marked = asked.join(known, "y", "left_semi").join(given, ["id", "y"], "left")
    return marked.groupBy("id").agg(F.count("*").alias("scoreable"), F.avg(F.coalesce("held", F.lit(0.0))).alias("share")).select("id", "scoreable", F.when(F.col("scoreable") >= least, F.col("share")).alias("coverage"))


def f_score(stats: list[tuple[int, int, int]], beta: float = 2.0) -> float:
    """Corpus chrF in percent from (matched, hypothesis total, reference total) of each order."""
    used = [(m / h, m / r) for m, h, r in stats if h and r]
    if not used:
        return 0.0
    precision, recall = (sum(v) / len(used) for v in zip(*used))
    below = beta * beta * precision + recall
    return 100 * (1 + beta * beta) * precision * recall / below if below else 0.0


def ngram_matches(pairs: DataFrame, hyp: str, ref: str, most: int = 4) -> DataFrame:
    """(n, matched, total, hyp_len, ref_len): sums for corpus BLEU over token arrays, clipped a pair."""
    out = None
    for n in range(1, most + 1):
        grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))  # noqa: E731, B023
        h = pairs.select("id", F.explode(grams(F.col(hyp))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("a"))
        r = pairs.select("id", F.explode(grams(F.col(ref))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("b"))
        met = h.join(r, ["id", "g"], "left").agg(F.coalesce(F.sum(F.least("a", F.coalesce("b", F.lit(0)))), F.lit(0)).alias("matched"), F.coalesce(F.sum("a"), F.lit(0)).alias("total"))
        row = met.select(F.lit(n).alias("n"), "matched", "total")
        out = row if out is None else out.unionByName(row)
    sizes = pairs.agg(F.sum(F.size(hyp)).alias("hyp_len"), F.sum(F.size(ref)).alias("ref_len"))
    return out.join(F.broadcast(sizes))


@F.pandas_udf(ArrayType(DoubleType()))
def bleu_row(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Ten sums of one pair of token arrays: matched and total of orders 1 to 4, and both lengths; null counts as empty."""
    from collections import Counter

    def one(h, r):
        h, r = ([] if h is None else list(h)), ([] if r is None else list(r))
        grams = [[Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for n in range(1, 5)] for x in (h, r)]
        met = [float((a & b).total()) for a, b in zip(*grams)]
        return [*met, *(float(a.total()) for a in grams[0]), float(len(h)), float(len(r))]

    return pd.Series([one(h, r) for h, r in zip(hyp, ref)])


def bleu_sums(c: str) -> list[Column]:
    """Aggregates of the ten sums of bleu_row()."""
    return [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(10)]


def bleu_of(c: str) -> Column:
    """Corpus BLEU in percent of the columns of bleu_sums()."""
    v = [F.col(f"{c}{i}") for i in range(10)]
    logs = sum((F.ln(v[i] / v[i + 4]) for i in range(4)), F.lit(0.0)) / 4
    whole = v[8] > 0
    for x in v[:8]:
        whole = whole & (x > 0)
    return F.when(whole, 100 * F.exp(F.least(F.lit(0.0), 1 - v[9] / v[8]) + logs)).otherwise(0.0)


def bleu(stats: list[tuple[int, int]], hyp_len: int, ref_len: int) -> float:
    """Corpus BLEU in percent from (matched, total) of each order."""
    import math

    if not hyp_len or any(m == 0 or t == 0 for m, t in stats):
        return 0.0
    brevity = min(0.0, 1 - ref_len / hyp_len)
    return 100 * math.exp(brevity + sum(math.log(m / t) for m, t in stats) / len(stats))


def bootstrap_interval(deltas: list[float], rounds: int = 10_000, seed: int = 11) -> tuple[float, float, float]:
    """Mean's 95 % interval and two-sided p of paired deltas, one for each cluster."""
    x = np.asarray(deltas, float)
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(rounds)])
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)), float(min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean())))


def average_linkage(vectors, threshold: float = 0.30) -> list[int]:
    """Agglomerative clusters of unit vectors by mean cosine distance; quadratic, for one bounded group."""
    v = np.asarray(vectors, float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    groups = [[i] for i in range(len(v))]
    sums = [v[i].copy() for i in range(len(v))]
    while len(groups) > 1:
        size = np.array([len(g) for g in groups], float)
        s = np.array(sums)
        away = 1 - (s @ s.T) / np.outer(size, size)
        np.fill_diagonal(away, np.inf)
        a, b = divmod(int(away.argmin()), len(groups))
        if away[a, b] > threshold:
            break
        a, b = min(a, b), max(a, b)
        groups[a] += groups.pop(b)
        sums[a] = sums[a] + sums.pop(b)
    out = [0] * len(v)
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query, id, cosine, place): the k rows (id, vector) nearest to each query by cosine, itself left out.

    Exact and in blocks: queries and rows are cut by hash into blocks of about `block`, each pair of blocks is
    one bounded multiplication that returns k rows a query, and the best of those are ranked. A zero or null
    vector has cosine 0 with every other. Cosines are rounded to six places, ties go to the smaller id.
    """
    import math

    parts = [max(1, math.ceil(df.count() / block)) for df in (queries, rows)]
    cut = lambda df, n: df.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = cut(queries, parts[0]).select("id", "vector", F.col("b").alias("qb"), spread(parts[1]).alias("rb"))
    given = cut(rows, parts[1]).select("id", "vector", F.col("b").alias("rb"), spread(parts[0]).alias("qb"))

    def unit(vectors) -> np.ndarray:
        size = max((len(v) for v in vectors if v is not None), default=1)
        m = np.array([np.zeros(size) if v is None else np.asarray(v, float) for v in vectors]).reshape(len(vectors), size)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm == 0, 1, norm)

    def multiply(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            ids = r["id"].to_numpy()
            near = np.round(unit(list(q["vector"])) @ unit(list(r["vector"])).T, 6)
            for i, line in zip(q["id"], near):
                best = np.lexsort((ids, -line))[: k + 1]
                out += [(i, ids[j], line[j]) for j in best if ids[j] != i][:k]
        return pd.DataFrame(out, columns=["query", "id", "cosine"])

    met = asked.groupBy("qb", "rb").cogroup(given.groupBy("qb", "rb")).applyInPandas(multiply, "query long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def linked_clusters(rows: DataFrame, threshold: float = 0.30, block: int = 2048) -> DataFrame:
    """(part, id, cluster): average-linkage clusters of the vectors of each part; cluster is the least id in it.

    Two clusters whose mean distance is within the threshold hold a pair that is, so every cluster lies inside
    one component of the graph of such pairs. The graph is found exactly, block against block: a multiplication
    returns a star for each of its components, never all pairs. Each
    component is then clustered whole, by one task: its size is not bounded.
    """
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    cut = tables.written(rows.join(sizes, "part").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")), "vectors")
    both = cut.select("part", "id", "vector", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    both = both.select("part", "id", "vector", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "i").distinct()

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.array(list(pdf["vector"]), float)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        left, right = (np.flatnonzero(pdf["i"].to_numpy() == pdf[c].iloc[0]) for c in ("u", "v"))
        close = 1 - m[left] @ m[right].T <= threshold + 1e-9
        ids = pdf["id"].to_numpy()
        whole = np.argwhere(close)
        label = np.arange(len(ids))
        while len(whole):
            low = label.copy()
            np.minimum.at(low, left[whole[:, 0]], label[right[whole[:, 1]]])
            np.minimum.at(low, right[whole[:, 1]], low[left[whole[:, 0]]])
            if (low == label).all():
                break
            label = low
        pairs = np.stack([ids, ids[label]])
        return pd.DataFrame({"part": pdf["part"].iloc[0], "a": pairs[0], "b": pairs[1]})[pairs[0] != pairs[1]]

    kind = rows.schema["part"].dataType.simpleString()
    edges = both.groupBy("part", "u", "v").applyInPandas(near, f"part {kind}, a long, b long")
    roots = tables.components(edges.select("a", "b").distinct())
    placed = cut.join(roots.withColumnRenamed("node", "id"), "id", "left").select("part", "id", "vector", F.coalesce("root", "id").alias("root"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        label = np.array(average_linkage(list(pdf["vector"]), threshold))
        least = pdf["id"].groupby(label).transform("min")
        return pd.DataFrame({"part": pdf["part"], "id": pdf["id"], "cluster": least})

    alone = placed.groupBy("part", "root").agg(F.count("*").alias("m")).where("m > 1").select("part", "root")
    many = placed.join(alone, ["part", "root"]).groupBy("part", "root").applyInPandas(cluster, f"part {kind}, id long, cluster long")
    return many.unionByName(placed.join(alone, ["part", "root"], "left_anti").select("part", "id", F.col("id").alias("cluster")))
