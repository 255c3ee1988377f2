"""Positions, components and clusters against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import learning, tables


def test_positions_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(1_500_000).select(F.xxhash64("id").alias("x"))
        got = tables.positions(rows, "x").agg(F.countDistinct("pos").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
        assert tuple(got) == (1_500_000, 0, 1_499_999)
        few = tables.positions(rows.limit(500), "x").collect()
        assert [r.x for r in sorted(few, key=lambda r: r.pos)] == sorted(r.x for r in few)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(3, 9), (9, 1), (50, 50)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 1, 9: 1, 1: 1, 50: 50}


def test_linked_clusters_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(int(k), int(k % 2), (centres[rng.integers(12)] + rng.normal(size=6) * 0.35).tolist()) for k in rng.permutation(160)]
    got = {r.id: r.cluster for r in learning.linked_clusters(spark.createDataFrame(rows, "id long, part int, vector array<double>"), block=30).collect()}
    want = {}
    for part in (0, 1):
        mine = sorted(r for r in rows if r[1] == part)
        label = learning.average_linkage([r[2] for r in mine])
        for r, c in zip(mine, label):
            want[r[0]] = min(x[0] for x, d in zip(mine, label) if d == c)
    assert got == want and 12 < len(set(got.values())) < 120
