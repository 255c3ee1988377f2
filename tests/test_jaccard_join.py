"""The similarity join against brute force."""

import random

import pytest

from sievework.operators import relational as rel


def brute(rows, least):
    points = {}
    for i, words in rows:
        if words:
            points[frozenset(words)] = min(i, points.get(frozenset(words), i))
    found = set()
    for v, i in points.items():
        for w, j in points.items():
            if i < j and len(v & w) >= least * len(v | w) - 1e-12:
                found.add((i, j, round(len(v & w) / len(v | w), 6)))
    return sorted(found)


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_is_brute_force_for_ids_that_repeat(spark, monkeypatch, least):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = rng.sample(range(400), rng.randrange(1, 60))
        rows += [[f"w{x if rng.random() > 0.03 * k else rng.randrange(400)}" for x in base] for k in range(6)]
    rows += [["w1"], ["w1"], ["w1", "w2"], [], ["a b"], ["a", "b"]]
    rows = [(i // 2, sorted(set(words))) for i, words in enumerate(rows)]  # an id has two sets
    monkeypatch.setattr(rel, "COMMON", 20)
    got = rel.jaccard_join(spark.createDataFrame(rows, "id long, words array<string>").repartition(3), least).collect()
    assert sorted({(r.a, r.b, round(r.jaccard, 6)) for r in got}) == brute(rows, least)


def test_candidates_are_few_and_words_are_not_grouped_by(spark):
    rng = random.Random(8)
    rows = [(i, [f"c{k}" for k in range(8)] + [f"w{x}" for x in rng.sample(range(3000), 30)]) for i in range(300)]
    found = rel.jaccard_join(spark.createDataFrame(rows, "id long, words array<string>"), 0.8)
    assert found.count() == 0
    assert "rank" not in found._jdf.queryExecution().optimizedPlan().toString()
