"""Packing documents into fixed-length training sequences: first-fit decreasing over a tournament tree.

Each document's ids, with an end id, are cut into full sequences and a rest. Pieces are dealt into groups
by a hash; the number of groups follows the number of pieces, so that a group stays small at any size.
In each group, on its own, pieces are placed from the longest to the shortest into the first sequence
that has room, found in a tournament tree whose nodes hold the largest room below them.

Cases: a null or empty text is its end id alone; rows that share a key are packed apart, the k-th such
row of an Arrow batch going to another group; ties in length go by key and start; an empty table gives
no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared, tokens

LENGTH, END = 2048, 1
#: Pieces a group, on average.
GROUP = 8192
CHUNK = 2 << 20


class Rooms:
    """A tournament tree over sequences: each node has the larger room of its two children."""

    def __init__(self, count: int, room: int):
        self.size = 1 << max(0, (count - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """The first sequence with room for need, and its room before."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        room = tree[at]
        tree[at] = room - need
        first = at - self.size
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left >= right else right
            if tree[at] == most:
                break
            tree[at] = most
        return first, room


def first_fit_decreasing(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; order lists the pieces from longest to shortest."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    full = lengths[order] == capacity
    where[order[full]], offset[order[full]] = np.arange(int(full.sum())), 0
    rest = order[~full]
    base, rooms = int(full.sum()), Rooms(max(1, len(rest)), capacity)
    for i, n in zip(rest.tolist(), lengths[rest].tolist()):
        at, room = rooms.place(n)
        where[i], offset[i] = base + at, capacity - room
    return where, offset


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, length: int = LENGTH, end: int = END, payload: str = "crc", chunk: int = CHUNK) -> DataFrame:
    """(key, copy, start, length, doc_tokens, ids_crc32 or ids): the pieces of each of docs.

    payload "ids" gives the ids themselves, little-endian in the smallest of two or four bytes that holds
    the vocabulary; "crc" their crc32 as unsigned 32-bit numbers. About chunk bytes of texts are encoded at once: fewer take
    less memory and more time, and give the same ids.
    """
    path = path or tokens.default_path()
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def work(batches):
        enc = tokens.encoder(path)
        for b in batches:
            data, offs = shared.utf8_view(b.column(1))
            raw, bounds, seen, copies = data.tobytes(), offs.tolist(), {}, []
            for k in b.column(0).to_pylist():
                copies.append(seen.get(k, 0))
                seen[k] = copies[-1] + 1
            for i, j in shared.row_slices(offs, chunk):
                ids, ends = enc.encode([raw[bounds[r] : bounds[r + 1]] for r in range(i, j)], end)
                sizes = np.diff(ends)
                number = -(-sizes // length)
                row = np.repeat(np.arange(j - i), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * length
                size = np.minimum(length, sizes[row] - start)
                a = ends[row] + start
                spans = list(zip(a.tolist(), (a + size).tolist()))
                if payload == "ids":
                    body = ids.astype(enc.dtype)
                    what = pa.array([body[x:y].tobytes() for x, y in spans], pa.binary())
                else:
                    body = ids.astype("<u4")
                    what = pa.array([zlib.crc32(body[x:y]) for x, y in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array(np.array(copies, np.int64)[row + i]), pa.array(start), pa.array(size), pa.array(sizes[row]), what], ["k", "copy", "start", "length", "doc_tokens", "what"])
            shared.tidy()

    out = slim.mapInArrow(work, shared.with_key(docs.schema[key].dataType, f"copy long, start long, length long, doc_tokens long, what {'binary' if payload == 'ids' else 'long'}"))
    return out.withColumnsRenamed({"k": key, "what": "ids" if payload == "ids" else "ids_crc32"})


def place(pieces: DataFrame, count: int, key: str = "doc_id", length: int = LENGTH, group: int = GROUP, seed: int = 0) -> DataFrame:
    """pieces with sequence_id (group's number in the upper bits) and offset."""
    groups = max(1, -(-count // group))
    dealt = pieces.withColumn("grp_", F.pmod(F.xxhash64(key, "copy", "start", F.lit(seed)), F.lit(groups)))
    names = pieces.columns
    parts = max(1, min(groups, 4096 if groups > 4096 else groups))
    dealt = dealt.repartition(parts, "grp_").sortWithinPartitions("grp_", F.desc("length"), key, "copy", "start")

    def work(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            own = held.column("grp_").to_numpy()
            last = int(np.searchsorted(own, own[-1], "left"))
            if last:
                yield from packed(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from packed(held)

    def packed(part):
        part = part.combine_chunks()
        own, sizes = part.column("grp_").to_numpy(), part.column("length").to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        seqs, offs = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        for i, j in zip(cuts[:-1], cuts[1:]):
            where, offset = first_fit_decreasing(sizes[i:j], np.arange(j - i), length)
            seqs[i:j], offs[i:j] = (own[i] << 32) + where, offset
        out = part.select(names).append_column("sequence_id", pa.array(seqs)).append_column("offset", pa.array(offs))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(work, StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields]))


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP, seed: int = 0, payload: str = "crc", chunk: int = CHUNK) -> DataFrame:
    """(key, copy, start, length, doc_tokens, ids_crc32 or ids, sequence_id, offset): one row a piece."""
    pieces = shared.materialize(cut(docs, text, key, path, length, end, payload, chunk), "pieces")
    return place(pieces, pieces.count(), key, length, group, seed)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids in order, from pack(payload="ids"); at most `length` ids each."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
