"""Token-id files in patched frame-of-reference blocks.

Ids are written in ascending document order, shard by shard. A block of 128 ids stores its least id, a
bit width chosen at a percentile of its differences from it, the differences packed at that width, and
a list of the differences that do not fit. A file is

    b"PFOR1\\n"
    blocks: u32 least, u8 width, u8 exceptions, u16 ids, u64 words[2 * width], then u8 places and u32 values of the exceptions
    index: u64 start of each block, i64 (document, has it a number, ids) of each document
    tail: u64 start of the index, u64 blocks, u64 documents, u64 ids, b"PFORTAIL"

so that any block, hence any document, is found without reading what is before it.

Cases: a null or empty text is its end id alone; a null document number is written last and comes back
null; rows that share a number follow each other in order of a hash of the text, and may go to several
files; a number is cast to long, and one that cannot be fails in ANSI mode or else is null; an empty table
writes no files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import archive, shared, tokens

END = 2
BLOCK, PERCENT = 128, 95
#: Text bytes a shard.
SHARD_BYTES = 32 << 20
FLUSH_IDS = 1 << 19
CHUNK = 2 << 20
LAST = (1 << 63) - 1
HEAD, TAIL = b"PFOR1\n", b"PFORTAIL"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as 2 * width words of 64 bits each."""
    out = np.zeros((len(values), 2 * width), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        out[:, word] |= values[:, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= values[:, j] >> np.uint64(64 - bit)
    return out


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 64)
        v = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - bit))
        out[:, j] = v & mask
    return out


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids; only the last can hold fewer than BLOCK."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    full = np.empty(count * BLOCK, np.uint64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(count, BLOCK)
    least = full.min(1)
    diff = full - least[:, None]
    ranked = np.partition(diff, PERCENT * BLOCK // 100, axis=1)[:, PERCENT * BLOCK // 100]
    widths = np.ceil(np.log2(ranked.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = diff[at]
        over = part >= np.uint64(1 << width)
        packed = pack_bits(part & np.uint64((1 << width) - 1), width).astype("<u8") if width else np.zeros((len(at), 0), "<u8")
        number = over.sum(1)
        for k, i in enumerate(at.tolist()):
            size = BLOCK if i < count - 1 else len(ids) - BLOCK * (count - 1)
            block = struct.pack("<IBBH", int(least[i]), width, int(number[k]), size) + packed[k].tobytes()
            if number[k]:
                places = np.flatnonzero(over[k])
                block += places.astype(np.uint8).tobytes() + part[k, places].astype("<u4").tobytes()
            out[i] = block
    return out


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given places of data."""
    raw = np.frombuffer(data, np.uint8)
    if not len(starts):
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(8)].copy().view([("least", "<u4"), ("width", "u1"), ("over", "u1"), ("size", "<u2")])[:, 0]
    out = np.zeros((len(starts), BLOCK), np.uint64)
    for width in np.unique(head["width"]).tolist():
        at = np.flatnonzero(head["width"] == width)
        if width:
            words = raw[starts[at][:, None] + 8 + np.arange(16 * width)].copy().view("<u8")
            out[at] = unpack_bits(words, width)
    for i in np.flatnonzero(head["over"]).tolist():
        n, a = int(head["over"][i]), int(starts[i]) + 8 + 16 * int(head["width"][i])
        out[i, raw[a : a + n]] = np.frombuffer(data, "<u4", n, a + n)
    out += head["least"][:, None].astype(np.uint64)
    sizes = head["size"].astype(np.int64)
    return out[np.arange(BLOCK) < sizes[:, None]].astype(np.uint32)


def _slim(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, h, t): the number, the text's tie, the text."""
    t = F.col(text).cast("string")
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(t).alias("h"), t.alias("t"))


def encoded(slim: DataFrame, bounds: archive.Bounds, path: str, end: int) -> DataFrame:
    """(shard, doc, h, ids): each document's ids, little-endian, in two bytes where the vocabulary allows."""

    def work(batches):
        enc = tokens.encoder(path)
        for b in batches:
            data, offs = shared.utf8_view(b.column(2))
            raw, at, doc, h = data.tobytes(), offs.tolist(), np.asarray(b.column(0)), np.asarray(b.column(1))
            shard = bounds.shard(doc, h)
            for i, j in shared.row_slices(offs, CHUNK):
                ids, ends = enc.encode([raw[at[r] : at[r + 1]] for r in range(i, j)], end)
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends * enc.dtype.itemsize), pa.py_buffer(ids.astype(enc.dtype))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:j]), pa.array(doc[i:j]), pa.array(h[i:j]), cells], ["shard", "doc", "h", "ids"])
        shared.tidy()

    return slim.mapInArrow(work, "shard int, doc long, h long, ids binary")


class BlockFile:
    """Writes one shard's file, a few blocks at a time."""

    def __init__(self, folder: str, shard: int):
        self.file = archive.TemporaryFile(folder, f"tokens-{shard:06d}.pfor", shard, 0)
        self.file.write(HEAD)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append((0 if doc == LAST else doc, int(doc != LAST), len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= FLUSH_IDS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        now = len(ids) if last else len(ids) // BLOCK * BLOCK
        blocks = encode(ids[:now])
        at = self.file.bytes
        for x in blocks:
            self.starts.append(at)
            at += len(x)
        self.file.write(b"".join(blocks))
        self.file.items += now
        self.held, self.waiting = [ids[now:]], len(ids) - now

    def close(self) -> tuple:
        self.flush(True)
        index = self.file.bytes
        self.file.write(np.array(self.starts, "<u8").tobytes() + np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        self.file.write(struct.pack("<QQQQ", index, len(self.starts), len(self.docs), self.file.items) + TAIL)
        self.file.records = len(self.docs)
        return self.file.close()


def write(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end: int = END, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Write docs to folder; the committed manifest and the number of shards."""
    path = path or tokens.default_path()
    slim = _slim(docs, text, key)
    bounds = archive.range_bounds(slim, F.col("doc"), F.col("h"), F.coalesce(F.octet_length("t"), F.lit(0)) + 64, shard_bytes)
    rows = archive.by_range(encoded(slim, bounds, path, end), bounds.shards, "doc", "h", "ids")
    dtype = tokens.encoder(path).dtype

    def work(batches):
        out, done = None, []
        for b in batches:
            for shard, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc").to_pylist(), b.column("ids")):
                if out is None or out.file.shard != shard:
                    if out is not None:
                        done.append(out.close())
                    out = BlockFile(folder, shard)
                out.add(doc, np.frombuffer(ids.as_buffer(), dtype).astype(np.uint32))
        if out is not None:
            done.append(out.close())
        if done:
            yield archive.manifest_batch(done)

    manifest = shared.materialize(rows.mapInArrow(work, archive.MANIFEST), "tokens-manifest")
    return archive.commit(manifest, folder), bounds.shards


class Reader:
    """One file: the index, and any run of blocks."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 40)
        tail = source.read(40)
        if tail[32:] != TAIL:
            raise ValueError("not a file of token blocks")
        index, blocks, docs, self.ids = struct.unpack("<QQQQ", tail[:32])
        source.seek(index)
        raw = source.read(size - 40 - index)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(index)).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", 3 * docs, 8 * blocks).reshape(-1, 3)

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive) of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        self.source.seek(int(self.starts[a]))
        data = self.source.read(int(self.starts[b] - self.starts[a]))
        return decode(data, self.starts[a:b] - self.starts[a])[first - a * BLOCK : last - a * BLOCK]


def read(manifest: DataFrame, shards: int, folder: str, payload: str = "crc") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 or ids) from the files.

    start counts the ids of all documents before: a running sum over the manifest, one number a file.
    """
    from pyspark.sql import Window

    before = F.sum("items").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    files = archive.by_range(manifest.select("shard", "part", "name", F.coalesce(before, F.lit(0)).alias("base")), shards, "part")

    def work(batches):
        fs, root = archive.filesystem(folder)
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    r = Reader(source)
                    ends = np.zeros(len(r.docs) + 1, np.int64)
                    np.cumsum(r.docs[:, 2], out=ends[1:])
                    for i, j in shared.row_slices(ends, 1 << 20):
                        ids = r.span(int(ends[i]), int(ends[j])).astype("<u4")
                        cells = [ids[x:y] for x, y in zip((ends[i:j] - ends[i]).tolist(), (ends[i + 1 : j + 1] - ends[i]).tolist())]
                        what = pa.array([zlib.crc32(x) for x in cells], pa.int64()) if payload == "crc" else pa.array([x.tobytes() for x in cells], pa.binary())
                        number = pa.array(r.docs[i:j, 0], mask=r.docs[i:j, 1] == 0)
                        yield pa.RecordBatch.from_arrays([number, pa.array(base + ends[i:j]), pa.array(r.docs[i:j, 2].copy()), what], ["doc_id", "start", "n_tokens", "what"])

    out = files.mapInArrow(work, f"doc_id long, start long, n_tokens long, what {'long' if payload == 'crc' else 'binary'}")
    return out.withColumnRenamed("what", "ids_crc32" if payload == "crc" else "ids")
