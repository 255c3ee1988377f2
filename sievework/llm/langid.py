"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training is stochastic gradient descent in numpy on the driver, over a sample of labelled rows whose
size is bounded by parameters; prediction reads every whole text in Arrow batches, without a shuffle.
A subword is a run of 3 or 4 bytes of the lower-cased text in which each run of bytes that are no
letters is one space. As the model is linear, prediction adds each bucket's class scores.

A calibration share of the sample, not trained on, sets a temperature and the least score at which a
prediction is accepted; rejected predictions keep their label and have accepted false.

Cases: null texts and texts without a letter are `und` with score 0, not accepted; rows without a label
are never learnt from; with no labelled row at all, everything is `und`; with one label only, that label
has score 1; repeated rows are predicted alike; an empty table gives an empty result; other columns are
ignored, whatever their names. Equal class scores go to the first label in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared

#: Rows of each label, of characters each at most, and labels to learn from at most.
SAMPLE_ROWS, SAMPLE_CHARS, MAX_LABELS = 300, 20_000, 500
BUCKETS, DIM, GRAMS = 1 << 15, 8, (3, 4)
#: Texts are learnt from in spaced pieces of these many bytes, so that short ones are known too.
PIECES = (48, 160, 640)
EPOCHS, RATE, BATCH = 3, 0.4, 32
#: Of predictions that are accepted, so many must be right on the calibration share.
PRECISION = 0.99
CHUNK = 1 << 19

#: Bytes after ASCII folding: letters stay, the rest is a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offs: np.ndarray):
    """For each n of GRAMS: buckets of the subwords of rows of lower-cased bytes, and the rows' offsets in them."""
    rows = len(offs) - 1
    # each row gets a space at both ends
    sizes = np.diff(offs) + 2
    at = np.zeros(rows + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    text = np.full(at[-1], 0x20, np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[:-1]] = False
    keep[at[1:] - 1] = False
    text[keep] = _FOLD[data]
    gap = text == 0x20
    drop = np.zeros(len(text), bool)
    drop[1:] = gap[1:] & gap[:-1]
    drop[at[:-1]] = False
    text = text[~drop]
    kept = np.zeros(len(drop) + 1, np.int64)
    np.cumsum(~drop, out=kept[1:])
    at = kept[at]
    of = np.repeat(np.arange(rows), np.diff(at))
    wide = text.astype(np.uint32)
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        v = wide[:m].copy()
        for k in range(1, n):
            v |= wide[k : m + k] << np.uint32(8 * k)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x9E3779B1)
        v += np.uint32(n * 0x85EBCA77 & 0xFFFFFFFF)
        v ^= v >> np.uint32(16)
        v *= np.uint32(0xC2B2AE3D)
        v >>= np.uint32(17)
        whole = of[:m] == of[n - 1 :]
        sizes = np.zeros(rows + 1, np.int64)
        np.cumsum(np.maximum(np.diff(at) - n + 1, 0), out=sizes[1:])
        yield v[whole], sizes


def class_scores(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of table over each row's subwords. A row longer than CHUNK is read in overlapping parts."""
    rows = len(offs) - 1
    total, count = np.zeros((rows, table.shape[1])), np.zeros(rows, np.int64)
    for i, j in shared.row_slices(offs, CHUNK):
        for a in range(offs[i], offs[j], CHUNK) if j == i + 1 else [offs[i]]:
            part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if j == i + 1:
                part = data[max(offs[i], a - max(GRAMS) + 1) : min(offs[j], a + CHUNK)]
                own = np.array([0, len(part)])
            for ids, ends in subwords(part, own):
                full = np.flatnonzero(np.diff(ends))
                if len(full):
                    total[i + full] += np.add.reduceat(table[ids], ends[full], axis=0)
                    count[i:j] += np.diff(ends)
    return total / np.maximum(count, 1)[:, None]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, offsets, and whether each text has a letter."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offs = shared.utf8_view(low)
    has = np.asarray(pc.fill_null(pc.match_substring_regex(low, r"\p{L}"), False))
    return data, offs, has


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: the embeddings under the softmax's weights
    bias: np.ndarray
    scale: float
    least: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        data, offs, has = folded(texts)
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        mean = class_scores(data, offs, self.table)
        p = softmax((mean + self.bias) * self.scale)
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        score = np.where(has, p[np.arange(len(p)), best], 0.0)
        return [self.labels[b] if h else "und" for b, h in zip(best, has)], score, has & (score >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """Embeddings and softmax by stochastic gradient descent; a fifth of the rows calibrates."""
    names = sorted(set(map(str, labels)))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, max(1, len(names)))), np.zeros(max(1, len(names))), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, labels)
    data, offs, _ = folded(pa.array(texts, pa.string()))
    held = rng.random(len(y)) < 0.2
    parts, marks, held_parts, held_marks = [], [], [], []
    for i in range(len(y)):
        for size in PIECES:
            for a in range(offs[i], offs[i + 1], 8 * size):
                (held_parts if held[i] else parts).append(data[a : min(a + size, offs[i + 1])])
                (held_marks if held[i] else marks).append(y[i])

    def packed(pieces):
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(x) for x in pieces], out=ends[1:])
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)), ends

    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = np.zeros((DIM, len(names)))
    bias = np.zeros(len(names))
    if not parts:
        parts, marks = held_parts, held_marks
    marks = np.array(marks)
    weight = len(marks) / (len(names) * np.maximum(np.bincount(marks, minlength=len(names)), 1))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(parts))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            found = list(subwords(*packed([parts[k] for k in pick])))
            if not found:
                continue
            ids = np.concatenate([x for x, _ in found])
            row = np.concatenate([np.repeat(np.arange(len(pick)), np.diff(e)) for _, e in found])
            sizes = np.maximum(np.bincount(row, minlength=len(pick)), 1)
            hot, where = np.unique(ids, return_inverse=True)
            share = np.zeros((len(pick), len(hot)))
            np.add.at(share, (row, where), 1.0 / sizes[row])
            mean = share @ emb[hot]
            grad = softmax(mean @ out + bias)
            grad[np.arange(len(pick)), marks[pick]] -= 1
            grad *= weight[marks[pick]][:, None] / len(pick)
            rate = RATE * 20 * (1 - epoch / EPOCHS)
            back = share.T @ (grad @ out.T)
            out -= rate * (mean.T @ grad)
            bias -= 0.1 * rate * grad.sum(0)
            emb[hot] -= rate * 20 * back
    table = (emb @ out).astype(np.float32)
    model = Model(names, table, bias, 1.0, 0.0)
    if held_parts:
        hd, ho = packed(held_parts)
        mean = class_scores(hd, ho, table)
        raw, hm = mean + bias, np.array(held_marks)
        scales = np.geomspace(0.25, 8, 21)
        loss = [-np.log(np.maximum(softmax(raw * s)[np.arange(len(hm)), hm], 1e-12)).mean() for s in scales]
        model.scale = float(scales[int(np.argmin(loss))])
        p = softmax(raw * model.scale)
        top, right = p.max(1), p.argmax(1) == hm
        order = np.argsort(-top, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precise >= PRECISION)
        model.least = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", usable: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about `rows` rows of each label, those whose hashed key is least; MAX_LABELS labels at most."""
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y"), (F.lit(True) if usable is None else usable).alias("u"))
    slim = slim.where(F.col("u") & F.col("y").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    sizes = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MAX_LABELS).collect()}
    if not sizes:
        return fit([], [])
    order = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30))
    chance = F.element_at(F.create_map(*[x for y, n in sizes.items() for x in (F.lit(y), F.lit(min(1 << 30, int((1 << 30) * 1.5 * rows / n) + 1)))]), F.col("y"))
    got = slim.where(F.col("y").isin(list(sizes)) & (order < chance)).withColumn("o", order)
    got = got.select("y", "t", "o").orderBy("o", "t").limit(2 * rows * len(sizes)).collect()
    seen: dict[str, int] = dict.fromkeys(sizes, 0)
    kept = []
    for r in got:
        if seen[r["y"]] < rows:
            seen[r["y"]] += 1
            kept.append(r)
    return fit([r["t"] for r in kept], [r["y"] for r in kept])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, and lang_pred, score and accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels numbers
    slim = docs.select(F.col(text).cast("string").alias("t_"), *keep)

    def work(batches):
        for b in batches:
            lang, score, sure = sent.value.predict(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], [*b.schema.names[1:], "lang_pred", "score", "accepted"])
        shared.tidy()

    return slim.mapInArrow(work, StructType([*slim.schema.fields[1:], *StructType.fromDDL("lang_pred string, score double, accepted boolean").fields]))
