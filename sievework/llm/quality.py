"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines.

Hashes roll over the words of a batch of texts in numpy, for several n-gram lengths at once; a text
is judged by the share of its characters that duplicated n-grams or lines cover. Narrow: no shuffle.

Cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored, whatever their names. Two n-grams
of a text are the same if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: The base rule's window, its least words and its limit in percent.
BASE_GRAM, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Largest share of a text's word characters inside duplicated n-grams, by n, and inside duplicated lines.
MAX_COVERAGE = {3: 0.45, 5: 0.40, 10: 0.35}
MAX_LINE_COVERAGE = 0.30
#: Most symbols a word.
MAX_SYMBOLS = 0.1
CHUNK = 1 << 19

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def measure(data: np.ndarray, offs: np.ndarray, grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each row; gram_chars_n are the characters of words inside n-grams found twice."""
    rows = len(offs) - 1
    inside = ~SPACE[data]
    ws, we = shared.word_bounds(inside, offs)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    first = np.searchsorted(ws, offs)  # of each row's words
    chars = letters[we] - letters[ws]
    out = {"n_words": np.diff(first), "word_chars": _per_row(chars, first), "n_symbols": _per_row(SYMBOL[data], offs)}
    prefix = shared.prefix_hash(data)
    salt = shared.mix64(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    newline = np.flatnonzero(data == 0x0A)
    # a line begins at each row's start and after each of its newlines; empty rows share a start
    starts = np.concatenate([offs[:-1], newline + 1])
    owner = np.concatenate([np.arange(rows), np.searchsorted(offs, newline, "right") - 1])
    order = np.lexsort((starts, owner))
    ls, row = starts[order], owner[order]
    le = np.empty(len(ls), np.int64)
    le[:-1] = np.where(row[1:] == row[:-1], ls[1:] - 1, offs[1:][row[:-1]])
    if len(ls):
        le[-1] = offs[-1]
    worded = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    ls, le, row = ls[worded], le[worded], row[worded]
    key = shared.span_hash(prefix, ls, le) ^ salt[row]
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(row[earlier], minlength=rows)[:rows].astype(np.int64)
    out["dup_line_chars"] = np.zeros(rows, np.int64)
    np.add.at(out["dup_line_chars"], row[earlier], letters[le[earlier]] - letters[ls[earlier]])

    words = shared.span_hash(prefix, ws, we)
    of = np.repeat(np.arange(rows), np.diff(first))
    rolled = shared.gram_prefix(words)
    for n in sorted({*grams, BASE_GRAM}):
        at = np.flatnonzero(np.arange(len(words)) + n <= first[1:][of])
        again = at[_again(shared.gram_hash(rolled, at, n) ^ salt[of[at]])] if len(at) else at
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + n, -1)
        covered = np.cumsum(edge[:-1]) > 0
        if n == BASE_GRAM:
            out["n_repeat_words"] = _per_row(covered, first)
        if n in grams:
            out[f"gram_chars_{n}"] = _per_row(chars * covered, first)
    return out


def repetition(docs: DataFrame, text: str = "text", key: str = "doc_id", grams: tuple[int, ...] = tuple(MAX_COVERAGE)) -> DataFrame:
    """One row for each of docs: its key, COUNTS, and gram_chars_n for each n of grams."""
    names = [*COUNTS, *(f"gram_chars_{n}" for n in grams)]

    def work(batches):
        for b in batches:
            data, offs = shared.utf8_view(b.column(1))
            found = [measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], grams) for i, j in shared.row_slices(offs, CHUNK)]
            cols = [pa.array(np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64), pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["k", *names])
        shared.tidy()

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(work, shared.with_key(docs.schema[key].dataType, ", ".join(f"{c} long" for c in names))).withColumnRenamed("k", key)


def verdict(measured: DataFrame, max_coverage: dict[int, float] | None = None) -> DataFrame:
    """Adds base_failed, the shares, and kept."""
    limits = MAX_COVERAGE if max_coverage is None else max_coverage
    n, size = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    shares = {f"gram_share_{k}": F.col(f"gram_chars_{k}") / size for k in limits} | {"line_share": F.col("dup_line_chars") / size}
    ok = (F.col("line_share") <= MAX_LINE_COVERAGE) & (F.col("n_symbols") <= MAX_SYMBOLS * n)
    for k, most in limits.items():
        ok &= F.col(f"gram_share_{k}") <= most
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return measured.withColumn("base_failed", base).withColumns(shares).withColumn("kept", ~F.col("base_failed") & ok)


def assess(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return verdict(repetition(docs, text, key))
