"""The SimHash step of near_dedup: trees propose, the exact similarity decides, prefix filtering adds the rest."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_neardup import brute, texts

from sievework.llm import neardup, simhash


def sets_of(spark, texts_):
    rows = [(d, simhash.of_hashes([s]), len(s), s.tolist()) for d, s in enumerate(neardup.shingles(t.encode()) for t in texts_)]
    return spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f, n, s) for d, f, n, s in rows], "d long, fp long, n long, hs array<long>"), {d: (f, set(s)) for d, f, _, s in rows}


def test_simhash_proposes_what_trees_link(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))] for _ in range(120)]
    kept = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base[:80]]  # one shingle differs
    df, known = sets_of(spark, kept)
    pairs = neardup.shared.materialize(neardup._proposed(neardup.shared.materialize(df, "sets")), "pairs")
    got = neardup._joined(pairs)
    root = {r.d: r.root for r in got.collect()}
    within = [(a, b) for a in known for b in known if a < b and (known[a][0] ^ known[b][0]).bit_count() <= neardup.RADIUS]
    assert len(within) >= 60 and all(root[a] == root[b] for a, b in within)
    assert pairs.count() < 2 * len(known)
    linked = neardup._alike(pairs, neardup.shared.materialize(df, "sets")).collect()
    assert len(linked) >= 60 and all(5 * len(known[r.a][1] & known[r.b][1]) >= 4 * len(known[r.a][1] | known[r.b][1]) for r in linked)


def test_stage_asks_simhash_and_loses_nothing_it_cannot_see(spark, monkeypatch):
    asked, found = [], simhash.links

    def links(points, count, radius=simhash.RADIUS, **more):
        asked.append((count, radius))
        return found(points, count, radius, **more)

    monkeypatch.setattr(simhash, "links", links)
    rows = list(enumerate(texts(5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {rows[i] for i in brute(rows)}
    assert {tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert len(asked) == 1 and asked[0][0] > 0 and asked[0][1] == neardup.RADIUS
    # trees that link all points to one: the exact similarity refuses what is not alike
    monkeypatch.setattr(simhash, "links", lambda points, *_, **__: points.crossJoin(points.agg(F.min("fp").alias("root"))))
    assert {tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
