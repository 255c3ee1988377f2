"""The near_dedup stage against brute-force Jaccard of five-word shingles."""

import random

import corpus_pipeline
from sievework.llm import neardup


def brute(rows):
    """Indices that stay: of each component the row of least doc_id, null ids last."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, i)), (key is None, key or 0, i))
    return {i for *_, i in best.values()}


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03):
            out.append(" ".join(word() if rng.random() < share else w for w in base))
    chain = [word() for _ in range(120)]
    for i in range(40):  # neighbours are alike, the ends are not
        chain[(i * 7) % 120] = word()
        out.append(" ".join(chain))
    passage = " ".join(word() for _ in range(40))
    return out + [passage + " " + " ".join(word() for _ in range(30)) for _ in range(60)] + ["one two", "ONE  two", "", None, "a b c d e f"] + out[:3]


def test_stage_is_brute_force(spark, monkeypatch):
    kept = texts()
    rows = list(enumerate(kept))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {rows[i] for i in brute(rows)}
    assert 60 < len(want) < len(rows) - 60
    for sample, many in ((neardup.SAMPLE, 4), (16, neardup.MANY)):
        monkeypatch.setattr(neardup, "MANY", many)
        monkeypatch.setattr(neardup, "ORDER_SAMPLE", sample)
        monkeypatch.setattr(neardup, "SAMPLE", sample)
        got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rows_that_share_a_number_or_have_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (None, b), (None, c), (None, c), (2, a + " more"), (3, ""), (3, c + " z"), (4, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, a), (1, b), (3, c + " z")]
