"""A deterministic sharded WARC writer and its reader.

Records are sorted by page number in shards that are contiguous ranges of it; a shard's files are rolled
once their compressed size reaches a limit. Headers and digests are made anew from the payload; each record
is a gzip member of its own. A payload that another record holds in full is written as a revisit: the
equal payloads' least page number is the response, the others refer to it. The same table gives the same
bytes whatever the partitions, as names, bounds, dates and record ids depend on the rows only.

The payloads are shuffled once. What tells revisits apart (number, digest, response) is summed by digest
before its own small shuffle, and meets the payloads in the sorted shard, so that one payload in a third
of all rows makes no large task.

Cases: a null payload is empty; payloads under MIN_REVISIT bytes are all responses; a null number counts
as the largest and comes back as null; rows that share a number are written in order of a hash of the payload
and may go to several shards, those that share the payload too to one, where the first is the response and
the others revisit it; a number is cast to long, and one that cannot be fails in ANSI mode or else is null; a null or empty url becomes `urn:page:<number>`; control characters and spaces
of a url are percent-encoded; an empty table gives an archive of no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import archive, shared

MIN_REVISIT = 100
#: Payload bytes a shard, and compressed bytes at which its next file begins.
SHARD_BYTES, ROLL_BYTES = 48 << 20, 4 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
LAST = (1 << 63) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[^\x21-\x7e]")
_NAMESPACE = uuid.UUID("6f1c1d3e-7d0a-5c39-9a52-0c5f6f0c8a11")


def record_id(number: int, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{number}/{digest}/{copy}')}>"


def _uri(url: str | None, number: int) -> bytes:
    if not url:
        return b"urn:page:%d" % number
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode())


def _record(fields: list[tuple[bytes, bytes]], block: bytes, level: int) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def response(number: int, copy: int, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """A response record, or a revisit of the record of page number refers, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    fields = [(b"WARC-Type", b"response" if refers is None else b"revisit"), (b"WARC-Record-ID", record_id(number, digest, copy).encode()), (b"WARC-Date", date.encode()), (b"WARC-Target-URI", _uri(url, number))]
    fields += [(b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()), (b"Content-Type", b"application/http; msgtype=response")]
    if number != LAST:
        fields.append((b"X-Page-Number", b"%d" % number))
    if refers is not None:
        fields += [(b"WARC-Profile", PROFILE.encode()), (b"WARC-Refers-To", record_id(refers, digest, 0).encode())]
        if refers != LAST:
            fields.append((b"X-Refers-To-Page-Number", b"%d" % refers))
    return _record(fields, block, level)


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(n, h, digest, response) for the rows whose payload of at least `least` bytes occurs again; h is the payload's tie."""
    ids = pages.where(F.octet_length("payload") >= least).select("n", F.xxhash64("payload").alias("h"), F.unhex(F.sha2("payload", 256)).alias("digest"))
    ids = shared.materialize(ids, "warc-ids")
    # A digest cannot be summed and joined with one exchange here: the second key lets the join's own
    # exchanges be split where one digest has very many rows.
    twice = ids.groupBy("digest").agg(F.min("n").alias("response"), F.count("*").alias("c")).where("c > 1").drop("c")
    tag = F.crc32("digest")
    return ids.withColumn("t", tag).join(twice.withColumn("t", tag), ["digest", "t"]).select("n", "h", "digest", "response").distinct()


def write(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str | None = "url", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, date: str = DATE) -> tuple[DataFrame, int]:
    """Write pages to folder; the committed manifest and the number of shards."""
    slim = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("n"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    tie = F.xxhash64("payload").alias("h")
    bounds = archive.range_bounds(slim, F.col("n"), tie, F.octet_length("payload") + 256, shard_bytes)
    told = revisits(slim)

    @F.pandas_udf("int")
    def shard_of(n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bounds.shard(n.to_numpy(), h.to_numpy()))

    none = F.lit(None).cast("binary")
    rows = slim.select("n", tie, F.lit(1).alias("kind"), "url", "payload", none.alias("digest"), F.lit(None).cast("long").alias("response"))
    rows = rows.unionByName(told.select("n", "h", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), none.alias("payload"), "digest", "response"))
    rows = archive.by_range(rows.withColumn("shard", shard_of("n", "h")), bounds.shards, "n", "h", "kind", "payload", "url")

    def work(batches):
        out, done, number, told, seen, copies = None, [], None, {}, set(), {}
        for b in batches:
            for n, h, kind, link, body, digest, first, shard in zip(*(b.column(c).to_pylist() for c in ("n", "h", "kind", "url", "payload", "digest", "response", "shard"))):
                if (n, h) != number:
                    number, told, seen, copies = (n, h), {}, set(), {}
                if kind == 0:
                    told[digest.hex()] = first
                    continue
                if out is not None and (out.shard != shard or out.bytes >= roll_bytes):
                    done.append(out.close())
                    part = out.part + 1 if out.shard == shard else 0
                    out = None
                else:
                    part = 0
                if out is None:
                    out = archive.TemporaryFile(folder, f"pages-{shard:06d}-{part:04d}.warc.gz", shard, part)
                    name = out.name.encode()
                    out.write(_record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", record_id(shard, name.decode(), part).encode()), (b"WARC-Date", date.encode()), (b"WARC-Filename", name), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                digest = hashlib.sha256(body).hexdigest()
                first = told.get(digest)
                refers = None if first is None or (first == n and digest not in seen) else first
                seen.add(digest)
                copy = copies.get(digest, 0)
                copies[digest] = copy + 1
                out.write(response(n, copy, link, body, digest, refers, date, level))
                out.records += 1
                out.items += len(body)
        if out is not None:
            done.append(out.close())
        if done:
            yield archive.manifest_batch(done)

    manifest = shared.materialize(rows.mapInArrow(work, archive.MANIFEST), "warc-manifest")
    return archive.commit(manifest, folder), bounds.shards


def records(stream, chunk: int = 1 << 20):
    """(fields, block) of each record of a file of gzip members."""
    z, parts, raw = zlib.decompressobj(31), [], stream.read(chunk)
    while raw:
        parts.append(z.decompress(raw))
        if z.eof:
            yield _parse(b"".join(parts))
            raw = z.unused_data or stream.read(chunk)
            z, parts = zlib.decompressobj(31), []
        else:
            raw = stream.read(chunk)
    if parts and any(parts):
        raise ValueError("the file ends inside a record")


def _parse(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    return fields, rest[: int(fields[b"Content-Length"])]


def read(manifest: DataFrame, shards: int, folder: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) from the files.

    Digests are checked against the blocks. A revisit's size is that of its HTTP header; its payload is null.
    """

    def work(batches):
        fs, base = archive.filesystem(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        kind = fields[b"WARC-Type"]
                        if kind == b"warcinfo":
                            continue
                        if b"sha256:" + hashlib.sha256(block).hexdigest().encode() != fields[b"WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block does not have its digest")
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                        if kind == b"response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload does not have its digest")
                        number, refers = fields.get(b"X-Page-Number"), fields.get(b"X-Refers-To-Page-Number")
                        rows.append((None if number is None else int(number), fields[b"WARC-Target-URI"].decode(), size, digest, kind.decode(), None if refers is None else int(refers), body if payload and kind == b"response" else None))
                        if len(rows) >= 2000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return archive.by_range(manifest, shards, "part").mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
