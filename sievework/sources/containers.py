"""Readers of files that hold other things: archives, office documents, databases, maps, JSON documents, answers.

Files are the unit of work: each is read whole by one task (`binaryFile`), so very large archives should be
split by their producer. A file that cannot be read gives one row with `error` set instead of failing the job.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as forms

_ROWS = 4096


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """parse(bytes) yields tuples of schema; rows get `path` first and `error` last."""
    names = ["path", *(c.strip().split(" ")[0] for c in schema.split(",")), "error"]

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for row in parse(content):
                        rows.append((name, *row, None))
                        if len(rows) == _ROWS:
                            yield pd.DataFrame(rows, columns=names).astype(object)
                            rows = []
                except Exception as error:  # noqa: BLE001 - a broken file is a row, not a lost job
                    rows.append((name, *[None] * (len(names) - 2), f"{type(error).__name__}: {error}"))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {schema}, error string")


def _unpacked(data: bytes) -> bytes:
    """Contents of all gzip members, told by the first bytes and not by the name."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, z.read(m)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    except tarfile.ReadError:
        yield "", _unpacked(data)


def archive_lines(spark: SparkSession, path: str, member: str = ".*") -> DataFrame:
    """(path, member, line, text, error): lines from 0 of the members whose whole name matches; a plain or gzip
    file is one member with an empty name. Undecodable bytes become the replacement character."""

    def parse(data: bytes):
        for name, content in _members(bytes(data)):
            if re.fullmatch(member, name):
                for i, line in enumerate(io.StringIO(content.decode("utf-8", "replace"), newline=None)):
                    yield name, i, line.rstrip("\n")

    return _files(spark, path, parse, "member string, line long, text string")


def office_text(spark: SparkSession, path: str, most: int = 20_000) -> DataFrame:
    """(path, text, truncated, error): paragraphs of .docx files, at most `most` characters, the rest is cut off and marked."""
    import xml.etree.ElementTree as xml

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def parse(data: bytes):
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            root = xml.fromstring(z.read("word/document.xml"))
        text = "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p"))
        yield text[:most], len(text) > most

    return _files(spark, path, parse, "text string, truncated boolean")


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """(path, *columns, error): a table of SQLite files, all values as text; opened in memory, never on a local disk."""
    import sqlite3

    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    query = f"SELECT {', '.join(f'CAST({quoted(c)} AS TEXT)' for c in columns)} FROM {quoted(table)}"

    def parse(data: bytes):
        con = sqlite3.connect(":memory:")
        try:
            con.deserialize(bytes(data))
            yield from con.execute(query)
        finally:
            con.close()

    return _files(spark, path, parse, ", ".join(f"{c} string" for c in columns))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents with their path; what does not parse is null in every column."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("path"))


def registered(spark: SparkSession, path: str, columns: list[str], registry: DataFrame) -> DataFrame:
    """Rows of TSV files whose name, less its extension, is a source of registry (source, ...); others fail the job."""
    from . import readers

    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("source"))
    known = raw.join((registry.select("source", F.lit(True).alias("known_")).distinct()), "source", "left")
    source = F.when(F.col("known_"), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("source is not registered: "), "source")))
    return known.select(source.alias("source"), *readers.fields("value", columns)).where(f"{columns[-1]} IS NOT NULL")


def merged_answers(answers: DataFrame, key: str, value: str, file: str = "file", line: str = "line") -> DataFrame:
    """(key, value, clash): the last file's last line wins; clash if a key has more than one value."""
    last = F.max_by(value, F.struct(file, line)).alias(value)
    return answers.groupBy(key).agg(last, (F.count_distinct(value) > 1).alias("clash"))


def html_fields(df: DataFrame, column: str) -> DataFrame:
    """df with the column's markup taken out, entities resolved and white space squeezed."""
    return df.withColumn(column, forms.plain_html(column))


# ------------------------------------------------------------------ maps in PBF


#: A number of the wire format: bytes of seven bits, the lowest first, of which the last is below 128.
_NUMBER = re.compile(rb"[\x80-\xff]*[\x00-\x7f]", re.DOTALL)
#: Bytes of fixed-size values by wire type.
_SIZES = {1: 8, 5: 4}


def _numbers(data: bytes) -> np.ndarray:
    """All numbers of a packed field at once."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw[: last[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _packed(data: bytes) -> list[int]:
    return _numbers(data).tolist()


def _deltas(data: bytes) -> list[int]:
    """Running sums of the zigzag numbers of a packed field."""
    x = _numbers(data)
    return np.cumsum((x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)).tolist()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers, or the bytes of what has a length."""
    at = 0

    def number() -> int:
        nonlocal at
        found = _NUMBER.match(data, at)
        if found is None:
            raise ValueError("the message ends inside a number")
        at = found.end()
        return int(_numbers(found[0])[0])

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        if kind != 2 and kind not in _SIZES:
            raise ValueError(f"wire type {kind}")
        size = number() if kind == 2 else _SIZES[kind]
        at += size
        yield tag >> 3, data[at - size : at]


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _blocks(data: bytes) -> Iterator[bytes]:
    """Primitive blocks of a file: length, header, blob, again and again."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        header = dict(_fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(_fields(data[at : at + header[3]]))
        at += header[3]
        if bytes(header[1]) == b"OSMData":
            yield bytes(blob[1]) if 1 in blob else zlib.decompress(bytes(blob[3]))


def _nodes(block: bytes) -> Iterator[tuple[int, float, float, dict]]:
    grain, lat0, lon0, strings, groups = 100, 0, 0, [], []
    for number, value in _fields(block):
        if number == 1:
            strings = [bytes(v).decode("utf-8", "replace") for _, v in _fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number == 19:
            lat0 = value if value < 1 << 63 else value - (1 << 64)
        elif number == 20:
            lon0 = value if value < 1 << 63 else value - (1 << 64)
    degrees = lambda base, v: (base + grain * v) / 1e9
    for group in groups:
        for number, value in _fields(group):
            if number == 1:
                f: dict = dict(_fields(value))
                tags = dict(zip((strings[i] for i in _packed(f.get(2, b""))), (strings[i] for i in _packed(f.get(3, b"")))))
                yield _signed(f[1]), degrees(lat0, _signed(f[8])), degrees(lon0, _signed(f[9])), tags
            elif number == 2:
                f = dict(_fields(value))
                at = 0
                keys = _packed(f.get(10, b""))
                for node, lat, lon in zip(_deltas(f[1]), _deltas(f[8]), _deltas(f[9])):
                    pairs = []
                    while at < len(keys) and keys[at]:
                        pairs.append((strings[keys[at]], strings[keys[at + 1]]))
                        at += 2
                    at += 1
                    yield node, degrees(lat0, lat), degrees(lon0, lon), dict(pairs)


def map_nodes(spark: SparkSession, path: str, tagged: bool = True) -> DataFrame:
    """(path, node, lat, lon, tags, error): nodes of PBF map files, plain and dense; tagged leaves out nodes without tags.
    Ways and relations are not read."""

    def parse(data: bytes):
        for block in _blocks(bytes(data)):
            for node, lat, lon, tags in _nodes(block):
                if tags or not tagged:
                    yield node, lat, lon, tags

    flat = lambda data: ((n, lat, lon, json.dumps(tags)) for n, lat, lon, tags in parse(data))
    rows = _files(spark, path, flat, "node long, lat double, lon double, tags string")
    return rows.withColumn("tags", F.from_json("tags", "map<string, string>"))


def last_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an explicit order."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("r_", r).where("r_ = 1").drop("r_")
