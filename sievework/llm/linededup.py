"""Line dedup that can be taken back: sharded cuckoo filters over exact reference-count tables.

The state is three tables in the shared folder, each a row of versions: a change writes what it changes and
leaves the rest as it is. `refs` has one row for each document and line key in it, with whether it came or
went; `counts` has for each key, by shard, the number of documents that hold it and the least of them;
`filters` has one cuckoo filter for each shard. Of several versions of a row the last one counts; after
COMPACT changes a table is written anew.

A batch's keys are first looked up in the filters of their shards: keys that a filter does not know are new
and go to `counts` as they are; only the others are joined with it. Deleting documents lowers the counts of
their own keys; a least document is sought again, among the references of its key, only where it is one of
those that go; keys left without a document leave filter and table. A filter that has become full is built
again, larger, from the exact table. So inserting and then deleting a batch restores every decision.

A key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased, as a 128-bit hash;
lines of fewer than MIN_CHARS code points have none. Keys in at least two documents keep their lines in
the least document only. A key's rows are summed before they are shuffled, so hot lines do no harm; the
exact joins re-exchange both sides, so that skewed partitions can be split.

Cases: a null or empty text is one empty line and stays empty; rows that share a key column value are
one document; a null document number counts as the largest; a repeated line in the least document stays
repeated; an empty table gives an empty result. Columns of the input named kept_text, n_lines or
n_dropped give way to the result's; all others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared
from .cuckoo import CuckooFilter, Full

MIN_CHARS = 10
#: Keys a shard, for choosing the number of shards.
SHARD_KEYS = 500_000
#: Versions that a table is written anew after.
COMPACT = 8
LAST = (1 << 63) - 1
_TAIL = re.compile(rb"[\x80-\xBF]")


def line_keys(raw: bytes, least: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line, None for lines that are too short."""
    out = []
    for line in raw.lower().split(b"\n"):  # bytes.lower and bytes.strip know ASCII only
        line = line.strip()
        size = len(line)
        if size >= least and size < 4 * least and not line.isascii():
            size -= len(_TAIL.findall(line))
        out.append(xxhash.xxh3_128_digest(line) if size >= least else None)
    return out


def references(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_CHARS) -> DataFrame:
    """(doc, hi, lo): the distinct line keys of each of docs."""
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).cast("string").alias("t"))

    def work(batches):
        for b in batches:
            data, offs = shared.utf8_view(b.column(1))
            raw, sizes, found = data.tobytes(), [], []
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist()):
                own = dict.fromkeys(line_keys(raw[i:j], least))
                own.pop(None, None)
                sizes.append(len(own))
                found.extend(own)
            both = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype(np.int64)
            doc = np.repeat(np.asarray(b.column(0)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc", "hi", "lo"])
        shared.tidy()

    return slim.mapInArrow(work, "doc long, hi long, lo long")


def _tagged(df: DataFrame) -> DataFrame:
    """A second join key of hi, so that a side summed by key is exchanged again and skew can be split."""
    return df.withColumn("tag", F.col("hi").bitwiseXOR(F.col("lo")))


KEY = ["shard", "hi", "lo"]


def _none(*names: str) -> list:
    return [F.lit(None).cast("long").alias(c) for c in names]


def _last(tables: tuple[DataFrame, ...], keys: list[str], values: list[str]) -> DataFrame:
    """The last version of each row."""
    if len(tables) == 1:
        return tables[0]
    every = None
    for v, t in enumerate(tables):
        t = t.select(*keys, *values, F.lit(v).alias("v"))
        every = t if every is None else every.unionByName(t)
    return every.groupBy(*keys).agg(F.max_by(F.struct(*values), "v").alias("x")).select(*keys, "x.*")


@dataclass(frozen=True)
class LineIndex:
    """A version of the state; every change returns a new one and leaves the old as it was."""

    spark: SparkSession
    ref_tables: tuple[DataFrame, ...] = ()
    count_tables: tuple[DataFrame, ...] = ()
    filter_tables: tuple[DataFrame, ...] = ()
    bits: int = 0
    keys: int = 0

    @classmethod
    def empty(cls, spark) -> "LineIndex":
        return cls(spark)

    @property
    def refs(self) -> DataFrame:
        """(doc, hi, lo) of the references held."""
        if not self.ref_tables:
            return self.spark.createDataFrame([], "doc long, hi long, lo long")
        return _last(self.ref_tables, ["doc", "hi", "lo"], ["held"]).where("held").drop("held")

    @property
    def counts(self) -> DataFrame:
        """(shard, hi, lo, n, least) of the keys held."""
        if not self.count_tables:
            return self.spark.createDataFrame([], "shard int, hi long, lo long, n long, least long")
        return _last(self.count_tables, KEY, ["n", "least"]).where("n > 0")

    @property
    def filters(self) -> DataFrame:
        if not self.filter_tables:
            return self.spark.createDataFrame([], "shard int, filter binary")
        return _last(self.filter_tables, ["shard"], ["filter"])

    def _shard(self, bits: int):
        return F.shiftright(F.shiftrightunsigned("hi", 32), 32 - bits).cast("int").alias("shard") if bits else F.lit(0).alias("shard")

    def _some(self, tables: tuple[DataFrame, ...], by: DataFrame, on: list[str]) -> tuple[DataFrame, ...]:
        """The rows of tables that share their columns on with by, which is materialized and has each once."""
        small = shared.stored_bytes(by) <= shared.BROADCAST_BYTES
        side = F.broadcast(by) if small else _tagged(by) if "hi" in on else by
        return tuple((t if small or "hi" not in on else _tagged(t)).join(side, on if small or "hi" not in on else [*on, "tag"], "left_semi").drop("tag") for t in tables)

    def insert(self, refs: DataFrame) -> "LineIndex":
        """Add references; those already held change nothing."""
        refs = shared.materialize(refs.select("doc", "hi", "lo").distinct(), "line-refs")
        if self.ref_tables:
            docs = shared.materialize(refs.select("doc").distinct(), "line-docs")
            again = self._some(self.ref_tables, docs, ["doc"])
            if any(not t.isEmpty() for t in again):
                held = replace(self, ref_tables=again).refs
                refs = shared.materialize(_tagged(refs).join(_tagged(held), ["doc", "hi", "lo", "tag"], "left_anti").drop("tag"), "line-refs")
        batch = shared.materialize(refs.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc").alias("least")), "line-batch")
        fresh = batch.count()
        bits = max(self.bits, int(np.ceil(np.log2(max(1, (fresh + self.keys) / SHARD_KEYS)))))
        old = self if bits == self.bits or not self.count_tables else self._resharded(bits)
        batch = batch.select(self._shard(bits), "hi", "lo", "n", "least")
        if not old.count_tables:
            new = counts = shared.materialize(batch, "line-counts")
            added = fresh
        else:
            looked = shared.materialize(old._look_up(batch), "line-looked")
            maybe = shared.materialize(looked.where("known").drop("known"), "line-maybe")
            were = replace(old, count_tables=old._some(old.count_tables, _once(maybe), KEY)).counts
            both = _tagged(maybe.withColumnsRenamed({"n": "n2", "least": "l2"})).join(_tagged(were), [*KEY, "tag"], "left")
            changed = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.col("n2")).alias("n"), F.least("least", "l2").alias("least"), F.col("n").isNull().alias("new"))
            changed = shared.materialize(changed.unionByName(looked.where("not known").drop("known").withColumn("new", F.lit(True))), "line-counts")
            new, counts = changed.where("new").drop("new"), changed.drop("new")
            added = new.count()
        out = replace(old, bits=bits, keys=old.keys + added, ref_tables=(*old.ref_tables, refs.withColumn("held", F.lit(True))), count_tables=(*old.count_tables, counts))
        return replace(out, filter_tables=_patched(out, old.filter_tables, new, None))._compacted()

    def _resharded(self, bits: int) -> "LineIndex":
        counts = shared.materialize(self.counts.select(self._shard(bits), "hi", "lo", "n", "least"), "line-counts")
        out = replace(self, count_tables=(counts,), filter_tables=(), bits=bits)
        return replace(out, filter_tables=_patched(out, (), counts, None))

    def _compacted(self) -> "LineIndex":
        if max(map(len, (self.ref_tables, self.count_tables, self.filter_tables))) <= COMPACT:
            return self
        refs = shared.materialize(self.refs.withColumn("held", F.lit(True)), "line-refs")
        return replace(self, ref_tables=(refs,), count_tables=(shared.materialize(self.counts, "line-counts"),), filter_tables=(shared.materialize(self.filters, "line-filters"),))

    def _look_up(self, batch: DataFrame) -> DataFrame:
        """batch with known: whether its shard's filter holds the key."""
        rows = batch.select("shard", F.lit(None).cast("binary").alias("filter"), "hi", "lo", "n", "least")
        shards = shared.materialize(batch.select("shard").distinct(), "line-shards")
        tools = replace(self, filter_tables=self._some(self.filter_tables, shards, ["shard"])).filters.select("shard", "filter", *_none("hi", "lo", "n", "least"))

        def work(batches):
            shard, held = None, None
            for shard_, part in _runs(batches):
                blobs = part.column("filter").drop_null()
                if shard_ != shard:
                    shard, held = shard_, None
                if len(blobs):
                    held = CuckooFilter.load(blobs[0].as_py())
                part = part.filter(pa.compute.is_valid(part.column("hi")))
                if part.num_rows:
                    hi, lo = (np.asarray(part.column(c)).view(np.uint64) for c in ("hi", "lo"))
                    known = held.contains(hi, lo) if held is not None else np.zeros(part.num_rows, bool)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("shard", "hi", "lo", "n", "least")), pa.array(known)], ["shard", "hi", "lo", "n", "least", "known"])

        both = rows.unionByName(tools).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return both.mapInArrow(work, "shard int, hi long, lo long, n long, least long, known boolean")

    def delete(self, gone: DataFrame) -> "LineIndex":
        """Take all references of the documents in gone (column doc) away."""
        if not self.ref_tables:
            return self
        gone = shared.materialize(gone.select("doc").distinct(), "line-gone")
        left = shared.materialize(replace(self, ref_tables=self._some(self.ref_tables, gone, ["doc"])).refs, "line-left")
        keys = shared.materialize(left.groupBy(self._shard(self.bits), "hi", "lo").agg(F.count("*").alias("less"), F.min("doc").alias("first")), "line-less")
        were = replace(self, count_tables=self._some(self.count_tables, _once(keys), KEY)).counts
        lower = _tagged(were).join(_tagged(keys), [*KEY, "tag"]).select(*KEY, (F.col("n") - F.col("less")).alias("n"), "least", (F.col("least") == F.col("first")).alias("lost"))
        lower = shared.materialize(lower, "line-lower")
        open_ = shared.materialize(lower.where("lost and n > 0").select("hi", "lo"), "line-open")
        others = replace(self, ref_tables=self._some(self.ref_tables, open_, ["hi", "lo"])).refs.join(shared.broadcast_if_small(gone), "doc", "left_anti")
        least = others.groupBy("hi", "lo").agg(F.min("doc").alias("next"))
        counts = _tagged(lower).join(_tagged(least), ["hi", "lo", "tag"], "left")
        counts = shared.materialize(counts.select(*KEY, "n", F.when(F.col("lost"), F.col("next")).otherwise(F.col("least")).alias("least")), "line-counts")
        dead = shared.materialize(counts.where("n = 0").select(*KEY), "line-dead")
        out = replace(self, keys=self.keys - dead.count(), ref_tables=(*self.ref_tables, left.withColumn("held", F.lit(False))), count_tables=(*self.count_tables, counts))
        return replace(out, filter_tables=_patched(out, self.filter_tables, None, dead))._compacted()

    def drops(self) -> DataFrame:
        """(doc, keys): the keys whose lines a document loses."""
        twice = _tagged(self.counts.where("n > 1").select("hi", "lo", "least"))
        lost = _tagged(self.refs).join(twice, ["hi", "lo", "tag"]).where("doc > least")
        return lost.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))


def _once(keys: DataFrame) -> DataFrame:
    """The keys of a materialized table that has each once."""
    out = keys.select(*KEY)
    out._shared_path = keys._shared_path
    return out


def _runs(batches):
    """(shard, rows) of batches sorted by shard."""
    for b in batches:
        shard = np.asarray(b.column("shard"))
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield int(shard[i]), b.slice(i, j - i)


def _patched(index: LineIndex, base: tuple[DataFrame, ...], new: DataFrame | None, dead: DataFrame | None) -> tuple[DataFrame, ...]:
    """base and a version of the filters of the shards that new keys come to or dead keys leave.

    Shards whose filter has no room are then built from the exact table, which is read for these shards only.
    """
    kinds = [df.select("shard", F.lit(kind).alias("kind"), F.lit(None).cast("binary").alias("filter"), "hi", "lo") for kind, df in ((1, dead), (2, new)) if df is not None]
    rows = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    if base:
        shards = shared.materialize(rows.select("shard").distinct(), "line-shards")
        held = replace(index, filter_tables=index._some(base, shards, ["shard"])).filters
        rows = rows.unionByName(held.select("shard", F.lit(0).alias("kind"), "filter", *_none("hi", "lo")))
    made = shared.materialize(_filters(rows), "line-filters")
    full = shared.materialize(made.where("filter is null").select("shard"), "line-full")
    if not full.isEmpty():
        exact = replace(index, count_tables=index._some(index.count_tables, full, ["shard"])).counts
        again = _filters(exact.select("shard", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("filter"), "hi", "lo"))
        made = shared.materialize(made.where("filter is not null").unionByName(again), "line-filters")
    return (*base, made)


def _filters(rows: DataFrame) -> DataFrame:
    """(shard, filter) from rows of kind 0, filters, 1, keys to take out, and 2, keys to put in; null for a full one."""

    def finish(shard, held, full, parts):
        if held is None:
            held = CuckooFilter.holding(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None if full else held.dump()], pa.binary())], ["shard", "filter"])

    def work(batches):
        shard, held, full, parts = None, None, False, []
        for shard_, part in _runs(batches):
            if shard_ != shard:
                if shard is not None:
                    yield finish(shard, held, full, parts)
                shard, held, full, parts = shard_, None, False, []
            kind = np.asarray(part.column("kind"))
            if (kind == 0).any():
                held = CuckooFilter.load(part.column("filter").drop_null()[0].as_py())
            hi, lo = (np.asarray(pa.compute.fill_null(part.column(c), 0)).view(np.uint64) for c in ("hi", "lo"))
            if held is None:
                parts.append((hi[kind == 2], lo[kind == 2]))
            elif not full:
                held.delete(hi[kind == 1], lo[kind == 1])
                try:
                    held.insert(hi[kind == 2], lo[kind == 2])
                except Full:
                    full = True
        if shard is not None:
            yield finish(shard, held, full, parts)

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(work, "shard int, filter binary")


def rewrite(docs: DataFrame, index: LineIndex, text: str = "text", key: str = "doc_id", least: int = MIN_CHARS) -> DataFrame:
    """All columns of docs, then kept_text, n_lines and n_dropped."""
    return _rewritten(docs, index.drops(), text, key, least)


def _rewritten(docs: DataFrame, drops: DataFrame, text: str, key: str, least: int) -> DataFrame:
    made = ("kept_text", "n_lines", "n_dropped")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in made))
    own, lost = shared.unused_name(docs, "doc_"), shared.unused_name(docs, "keys_")
    drops = drops.select(F.col("doc").alias(own), F.col("keys").alias(lost))
    both = docs.withColumn(own, F.coalesce(F.col(key).cast("long"), F.lit(LAST))).join(drops, own, "left").drop(own)
    fields = [f for f in both.schema.fields if f.name != lost]
    at = docs.columns.index(text)

    def work(batches):
        for b in batches:
            data, offs = shared.utf8_view(b.column(at).cast(pa.string()))
            raw, keys = data.tobytes(), b.column(b.num_columns - 1)
            kept, lines, dropped = [], [], []
            for row, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                own, gone = raw[i:j], 0
                n = own.count(b"\n") + 1
                if keys[row].is_valid:
                    pairs = keys[row].values
                    lose = {bytes(x) for x in np.stack([np.asarray(pairs.field(c)) for c in (0, 1)], 1).astype(">i8")}
                    stay = [line for line, k in zip(own.split(b"\n"), line_keys(own, least)) if k not in lose]
                    gone = n - len(stay)
                    own = b"\n".join(stay)
                kept.append(own)
                lines.append(n)
                dropped.append(gone)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*b.schema.names[:-1], *made])
        shared.tidy()

    schema = StructType([*fields, *StructType.fromDDL("kept_text string, n_lines long, n_dropped long").fields])
    return both.select(*(f.name for f in fields), lost).mapInArrow(work, schema)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_CHARS, batches: int = 2) -> DataFrame:
    """Insert docs into an empty index in batches, then rewrite them. Of the index only the drops stay on disk."""
    spark = docs.sparkSession
    with shared.scratch(spark) as keep:
        refs = shared.materialize(references(docs, text, key, least), "line-found")
        index = LineIndex.empty(spark)
        for k in range(batches):
            index = index.insert(refs.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k))
            shared.sweep(spark)
        drops = keep(shared.materialize(index.drops(), "line-drops"))
    return _rewritten(docs, shared.broadcast_if_small(drops), text, key, least)

