"""Counts and gains of grams by rows of Arrow batches against brute force, by arrays and by sorting, small and large models."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievework.operators import learning, tables
from sievework.plans import catalog

SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(4)
    return ["", None, "A", "\x00b", "\U0010ffff퟿", "", "éa😀"] + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(60))) for _ in range(80)]


@pytest.mark.parametrize("dense", [0, learning.DENSE])
def test_key_grams_are_brute_force(monkeypatch, dense):
    monkeypatch.setattr(learning, "DENSE", dense)
    rows = texts()
    keys = np.arange(len(rows)) % 3
    want = Counter()
    for k, t in zip(keys.tolist(), rows):
        want.update((k, g) for g in ([""] if t == "" else [t[i : i + n] for n in (1, 2, 3) for i in range(len(t or "") - n + 1)]))
    got = [x for part in learning._key_grams(keys, 3, pa.array(rows)) for x in zip(*(c.tolist() for c in part))]
    spell = lambda x: "".join(chr(c - 1) for c in (x >> 42, x >> 21 & (1 << 21) - 1, x & (1 << 21) - 1) if c)
    assert len(got) == len(want) and {(k, spell(x)): c for k, x, c in got} == want


def test_sums_of_a_task_lose_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(list(zip([x or "none" for x in ["a", "b", None] * 29], texts())), "label string, text string").repartition(2)
    want = sorted(map(tuple, learning._gram_counts(rows, "label", "text").groupBy("key", "number").sum("c").collect()))
    for held in (8, 1 << 20):
        monkeypatch.setattr(learning, "HELD", held)
        assert sorted(map(tuple, learning._gram_counts(rows, "label", "text", few=True).groupBy("key", "number").sum("c").collect())) == want


def test_small_and_large_models_predict_as_sql_does(spark, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT id, predicted FROM ({catalog.oracle_sql()['nb_predict']})").fetchall())
    got = catalog.queries()["nb_predict"](spark, SF)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for each document, gram and label
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(tables, "is_small", lambda df, limit=0: False)
    assert sorted(map(tuple, catalog.queries()["nb_predict"](spark, SF).collect())) == want
