import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import learning, numeric, resample
from sievework.streaming import events, stateful


@pytest.mark.parametrize(
    "a, b, odd",
    [([30000.0], [60000.0], True), ([90.0], [1990.0], False), ([127.0, 158.0], [280.0, 350.0], False), ([15.0], [], False), ([20.0], [68.0], False), ([5.0, 5.0], [5.0, 9.0], True), ([1.8], [1.8], False)],
)
def test_numbers_disagree(a, b, odd):
    assert numeric.disagree(a, b) is odd


def test_numbers_disagree_takes_nulls(spark):
    rows = spark.createDataFrame([(1, [3.0], None), (2, [3.0], [700.0])], "id int, a array<double>, b array<double>")
    assert [r["d"] for r in rows.orderBy("id").select(numeric.numbers_disagree("a", "b").alias("d")).collect()] == [False, True]


def test_contrasts_refuse_what_the_reverse_denies(spark):
    rows = [("general", "tajnik", 5, 6, 9), ("sekretar", "tajnik", 9, 9, 9), ("firma", "tvrtka", 4, 4, 8)]
    pairs = spark.createDataFrame(rows, "x string, y string, n long, seen_x long, seen_y long").withColumn("dice", 2 * F.col("n") / (F.col("seen_x") + F.col("seen_y")))
    assert {r["x"]: r["verdict"] for r in learning.contrasts(pairs, 3, 0.6, 0.3).collect()} == {"general": "reverse differs", "sekretar": "admitted", "firma": "admitted"}


def test_families_need_a_counterpart_that_agrees(spark):
    rows = [("svjetlo", "svetlo"), ("svjetlost", "svetlost"), ("prijedlog", "predlog"), ("prijevoz", "prevoz"), ("jul", "jul")]
    found = {r["word"]: r["root"] for r in learning.families(spark.createDataFrame(rows, "word string, other string")).collect()}
    assert found == {"svjetlo": "svjetlo", "svjetlost": "svjetlo", "prijedlog": "prijedlog", "prijevoz": "prijevoz", "jul": "jul"}


def test_coverage_abstains_below_the_least(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "q"], ["a", "x", "y"]), (2, ["a"], ["a"])], "id int, xs array<string>, ys array<string>")
    table = spark.createDataFrame([("b", "x", 0.5), ("q", "y", 0.01)], "x string, y string, p double")
    got = {r["id"]: (r["scoreable"], r["coverage"]) for r in learning.coverage(pairs, "xs", "ys", table, frequent=1, least=3).collect()}
    assert got == {1: (3, pytest.approx(2 / 3)), 2: (1, None)}


def test_ratio_interval(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", rng.gauss(0.5, 0.1), 1.0) for i in range(200)]
    stats = spark.createDataFrame(rows, "c string, n double, d double")
    one, many = (resample.ratio_interval(stats.repartition(k), "c", "n", "d", 400).first() for k in (1, 7))
    assert one["value"] == pytest.approx(sum(r[1] for r in rows) / 200)
    assert one["lo"] < one["value"] < one["hi"] and one["hi"] - one["lo"] < 0.06 and one["p"] == 0
    assert (one["lo"], one["hi"]) == pytest.approx((many["lo"], many["hi"]))
    assert resample.ratio_interval(stats.where("false"), "c", "n", "d", 10).first()["value"] is None


def test_power_grows_with_the_gap(spark):
    found = {r["gap"]: r["found"] for r in resample.power(spark.range(1).selectExpr("500L AS n"), [0.0, 0.05, 0.3], trials=40, rounds=100).collect()}
    assert found[0.0] < 0.3 < found[0.3] and found[0.05] <= found[0.3]


def test_f_score():
    assert learning.f_score([(3, 3, 3), (2, 2, 2)]) == 100 and learning.f_score([(0, 3, 3)]) == 0
    assert learning.f_score([(1, 2, 4)]) == pytest.approx(100 * 5 * 0.5 * 0.25 / (4 * 0.5 + 0.25))


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(2):
        df.where(F.floor(F.col("event_id") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events.event_stream(spark, str(tmp_path / "in"), df.schema)


def test_within_budget(stream):
    rows = events.drain(stateful.within_budget(stream, "user_id", "value", 5.0), "budget").collect()
    assert sorted((r["key"], r["id"]) for r in rows) == [("0", 0), ("0", 2), ("1", 1), ("1", 3)]


def test_running_sample(stream):
    rows = events.drain(stateful.running_sample(stream, "user_id", 2), "sample", "update").collect()
    last = {r["key"]: r for r in sorted(rows, key=lambda r: r["seen"])}
    assert all(last[k]["seen"] == 4 and len(last[k]["ids"]) == 2 for k in ("0", "1"))


def test_suppressed(stream):
    rows = stream.selectExpr("event_id AS id", "user_id AS rank")
    got = events.drain(stateful.suppressed(rows, F.lit("k"), "rank"), "sup").collect()
    assert sorted(r["id"] for r in got) == [0, 2, 4, 6]


def test_bleu_rows_add_up_to_the_corpus(spark):
    rows = [(1, "the cat sat on the mat today".split(), "the cat sat on a mat today".split()), (2, "a b c d e".split(), "a b c d f g".split()), (3, [], ["x"])]
    df = spark.createDataFrame(rows, "id int, hyp array<string>, ref array<string>")
    got = df.select(learning.bleu_row("hyp", "ref").alias("s")).agg(*learning.bleu_sums("s")).select(learning.bleu_of("s")).first()[0]
    found = learning.ngram_matches(df, "hyp", "ref").orderBy("n").collect()
    assert got == pytest.approx(learning.bleu([(r["matched"], r["total"]) for r in found], found[0]["hyp_len"], found[0]["ref_len"])) and got > 0


def test_bleu_gap(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, words[i % 5 : i % 5 + 12]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ref array<string>")
    arms = df.select("id", learning.bleu_row(F.slice("ref", 1, 8), "ref").alias("s"), learning.bleu_row("ref", "ref").alias("t"))
    one, many = (resample.bleu_gap(arms.repartition(k), "id", "s", "t", 100).first() for k in (1, 5))
    assert one["lo"] <= one["gap"] <= one["hi"] and one["p"] == 0 and one["gap"] > 10
    assert tuple(one) == pytest.approx(tuple(many))


def test_nearest_in_blocks_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=4).tolist() for i in range(60)}
    vectors[7], vectors[8], vectors[9] = [0.0] * 4, None, vectors[3]
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")

    def cosine(a, b):
        if a is None or b is None or not any(a) or not any(b):
            return 0.0
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0

    want = {q: sorted(((-cosine(vectors[q], v), i) for i, v in vectors.items() if i != q))[:3] for q in range(0, 60, 20)}
    rows = learning.nearest(df.where("id % 20 = 0"), df, 3, block=16).collect()
    assert {(r["query"], r["place"], r["id"]) for r in rows} == {(q, k + 1, i) for q, best in want.items() for k, (_, i) in enumerate(best)}
    assert learning.nearest(df.where("false"), df, 3).count() == 0


def test_translation_table_of_many_rounds(spark):
    rows = [(1, ["kuća", "velika"], ["house", "big"]), (2, ["kuća"], ["house"]), (3, ["velika"], ["big"])] * 2
    df = spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(rows)], "id int, xs array<string>, ys array<string>")
    got = {(r["x"], r["y"]): r["p"] for r in learning.translation_table(df, "xs", "ys", 6).collect()}
    assert got["kuća", "house"] > 0.95 and got["velika", "big"] > 0.95


def test_translation_table_in_blocks_is_brute_force(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(learning, "CELLS", 40)
    rng = random.Random(4)
    some = lambda c, n: [f"{c}{rng.randrange(9)}" for _ in range(rng.randrange(n))]
    rows = [(i // 2 if i < 20 else i, some("a", 7), some("b", 9)) for i in range(60)] + [(61, None, ["b1"]), (62, ["a1", None], ["b1", None]), (None, ["a1"], ["b1"])]
    sets = [(i, set(a or ()) - {None}, [y for y in b if y]) for i, a, b in rows]
    met = Counter((x, y) for _, a, b in sets for x in a for y in set(b))
    p = {k: 1.0 for k, n in met.items() if n >= 2}
    for _ in range(2):
        z, c, total = Counter(), Counter(), Counter()
        for i, a, b in sets:
            for x, y in ((x, y) for x in a for y in set(b) if (x, y) in p):
                z[i, y] += p[x, y]
        for i, a, b in sets:
            for x, y in ((x, y) for x in a for y in b if (x, y) in p):
                c[x, y] += p[x, y] / z[i, y]
        for (x, _), v in c.items():
            total[x] += v
        p = {(x, y): v / total[x] for (x, y), v in c.items()}
    df = spark.createDataFrame(rows, "id int, xs array<string>, ys array<string>").repartition(3)
    got = {(r["x"], r["y"]): r["p"] for r in learning.translation_table(df, "xs", "ys", 2).collect()}
    assert got == pytest.approx({k: v for k, v in p.items() if v >= 1e-4})
    assert learning.translation_table(df.where("false"), "xs", "ys", 2).count() == 0


def test_bayes_counts_are_brute_force_and_not_exchanged_by_gram_and_row(spark):
    from collections import Counter

    rng = random.Random(6)
    texts = ["", None, "A", "éÉ", "\x00﻿", "😀bc"] + ["".join(rng.choice("abcdE ") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i // 2 if i < 8 else i, ["en", "fr", None][i % 3], t) for i, t in enumerate(texts)] + [(900, "en", "ab" * 30), (901, "xx", "\x00﻿" * 4)]
    grams = lambda t: [""] if t == "" else [t[i : i + n] for n in (1, 2, 3) for i in range(len(t or "") - n + 1)]
    counted = Counter((lang, g) for _, lang, t in rows for g in grams(t and t.lower()))
    want = {k: n for k, n in counted.items() if len(k[1]) == 1 or n >= 3}
    df = spark.createDataFrame(rows, "id int, lang string, text string").repartition(3)
    model = learning.bayes_train(df, "lang", "text")
    assert {(r["label"], r["gram"]): r["n"] for r in model.collect()} == want
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan, plan
    total, size = Counter(), len({g for _, g in want})
    for (lang, _), n in want.items():
        total[lang] += n
    score, asked = {}, {}
    for i, _, t in rows:
        asked.setdefault(i, []).extend(grams(t and t.lower()))
    for i, found in asked.items():
        for lang, n in total.items():
            known = sum(math.log(want.get((lang, g), 0) + 1) for g in found) if lang else 0
            score[i, lang] = round(known - len(found) * math.log(n + size), 6)
    got = {r["id"]: r["predicted"] for r in learning.bayes_predict(df.select("id", "text"), model, "text", "en").collect()}
    assert set(got) == {i for i, found in asked.items() if found}
    for i, lang in got.items():
        best = max(score[i, x] for x in total)
        assert score[i, lang] >= best - 2e-6 and (lang == "en" or score[i, "en"] < best + 2e-6)
