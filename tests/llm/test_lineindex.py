"""The line index over several shards, with growth, full filters and deletions, against sets in Python."""

import random

from pyspark.sql import functions as F

from sievework.llm import cuckoo, linededup, shared, simhash


def state(index):
    return sorted(map(tuple, index.counts.select("hi", "lo", "n", "least").collect()))


def want(held):
    by = {}
    for doc, hi, lo in held:
        by.setdefault((hi, lo), set()).add(doc)
    return sorted((*k, len(v), min(v)) for k, v in by.items())


def check(spark, index, held):
    assert state(index) == want(held) and index.keys == len(want(held))
    assert sorted(map(tuple, index.refs.collect())) == sorted(held)
    counts = index.counts.where("n > 0").withColumns({"n": F.lit(1).cast("long"), "least": F.lit(0).cast("long")})
    assert index._look_up(shared.materialize(counts, "t")).where("not known").count() == 0  # no key that is held is missed


def test_random_changes(spark, monkeypatch, compact=3):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 300)
    monkeypatch.setattr(linededup, "COMPACT", compact)
    rng = random.Random(compact)
    key = lambda k: ((k * 0x9E3779B97F4A7C15 % (1 << 64)) - (1 << 63), k)
    pool = [key(k) for k in range(2500)]
    index, held, seen = linededup.LineIndex.empty(spark), set(), set()
    for step in range(3):
        docs = range(step * 40, step * 40 + 40)
        new = {(d, *rng.choice(pool[: 400 * (step + 2)])) for d in docs for _ in range(25)} | set(rng.sample(sorted(held), min(len(held), 30)))
        index = index.insert(spark.createDataFrame(sorted(new), "doc long, hi long, lo long").repartition(2))
        held |= new
        seen.add(index.bits)
        if step:
            gone = rng.sample(sorted({d for d, *_ in held}), 25)
            index = index.delete(spark.createDataFrame([(d,) for d in gone], "doc long"))
            held = {x for x in held if x[0] not in gone}
    check(spark, index, held)
    assert len(seen) > 1 and index.filters.count() == 1 << index.bits
    index = index.delete(index.refs.select("doc"))
    assert state(index) == [] and index.keys == 0


def test_a_full_filter_is_built_again(spark):
    rows = lambda a, b: spark.createDataFrame([(k % 7, k * 7919, k) for k in range(a, b)], "doc long, hi long, lo long")
    index = linededup.LineIndex.empty(spark).insert(rows(0, 40))
    small = len(index.filters.first()["filter"])
    index = index.insert(rows(40, 4000))
    assert len(index.filters.first()["filter"]) > small
    check(spark, index, {(k % 7, k * 7919, k) for k in range(4000)})


def test_a_filter_takes_out_what_shares_a_bucket():
    import numpy as np

    f = cuckoo.CuckooFilter(8)
    hi, lo = np.zeros(6, np.uint64), np.zeros(6, np.uint64)  # one bucket pair, one mark
    f.insert(hi, lo)
    f.delete(hi[:5], lo[:5])
    assert np.count_nonzero(f.table) == 1 and f.contains(hi[:1], lo[:1]).all()
    f.delete(hi[:1], lo[:1])
    assert not f.table.any()


def test_connected_by_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOCAL", 60)
    rng = random.Random(4)
    chain = [(i + 1, i) for i in range(300)]  # a long path, in any order
    tree = [(rng.randrange(i) + 1000, i + 1000) for i in range(1, 200)]
    edges = chain + tree + [(5000, 5001), (7, 7)]
    rng.shuffle(edges)
    got = simhash.connected(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 301)} | {(i + 1000, 1000) for i in range(1, 200)} | {(5001, 5000)}
