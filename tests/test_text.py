import pytest
from pyspark.sql import functions as F

from sievework.functions import stats, text
from sievework.operators import learning, relational as rel
from sievework.plans.corpus import source_rejection


def one(spark, value, form):
    return spark.createDataFrame([(value,)], "x string").select(form("x").alias("y")).first()["y"]


def test_near_key(spark):
    assert one(spark, "Dobar   dan!", text.near_key) == one(spark, "dobar dan", text.near_key) == "dobar dan"


def test_flatten(spark):
    assert one(spark, "a\tb\nc   d", text.flatten) == "a b c d"
    assert one(spark, None, text.flatten) == ""


@pytest.mark.parametrize(
    "line, reason",
    [("nogomet je 1" + "0" * 99 + " puta bolji", "long token/number"), ("mjauuuu ide", "repeated alphanumeric"), ("сви људи", "non-Latin script"), ("*** --- !!!", "no Latin text"), ("ovo je dobra rečenica", None)],
)
def test_source_rejection(spark, line, reason):
    assert one(spark, line, source_rejection) == reason


@pytest.mark.parametrize(
    "given, count", [("Rođen je 5. maja 1990. godine u Sarajevu.", 1), ("Sastanak je u 9.30. Dođite ranije! Ok?", 3), ("Prva.\n\n  Druga.", 2)]
)
def test_served_sentences(spark, given, count):
    assert len(one(spark, given, text.served_sentences)) == count


def test_curated_sentences():
    assert text.sentences("Dr. Ivo dođe. Ode U.S. Armija! Kraj\nNovi red") == ["Dr. Ivo dođe.", "Ode U.S. Armija!", "Kraj", "Novi red"]


@pytest.mark.parametrize(
    "given, want",
    [("DANGER HIGH VOLTAGE KEEP OUT", "Danger high voltage keep out"), ("ROĐEN JE 5. MAJA 1990. GODINE", "Rođen je 5. maja 1990. godine"), ("NASA", "NASA"), ("12345 6789", "12345 6789"), ("Mixed Case here", "Mixed Case here")],
)
def test_sentence_case(given, want):
    assert text.recased(given) == want


def test_rewrite_keeps_case(spark):
    rewrite = text.rewriter({"vreme": "vrijeme", "reč": "riječ", "svet": "svijet"})
    assert one(spark, "Reč 5, VREME 2! Vreme.", lambda c: rewrite(F.col(c))) == "Riječ 5, VRIJEME 2! Vrijeme."


def test_scripts_round_trip(spark):
    assert one(spark, "Ljubav, NJIVA i džep čćđšž", text.to_cyrillic) == "Љубав, ЊИВА и џеп чћђшж"
    assert one(spark, "Љубав и џеп", text.to_latin) == "LJubav i džep"


def test_numbers(spark):
    assert one(spark, "1,8 i 100.000 i 3.", text.numeric_values) == [1.8, 100000.0, 3.0]


def test_batches_and_shares():
    got = rel.batches_within([10, 200, 50, 60, 5, 256, 1, 1, 1], 256)
    assert got == sorted(got)
    for k in set(got):
        own = [w for w, b in zip([10, 200, 50, 60, 5, 256, 1, 1, 1], got) if b == k]
        assert len(own) == 1 or len(own) * max(own) <= 256
    assert rel.share_copies(12, 3, 0.5) == 4


def test_word_errors(spark):
    rows = spark.createDataFrame([("dobar dan svima", "dobar dan"), ("hvala", "hvala")], "a string, b string")
    got = rows.select(text.word_edits(text.score_tokens("a"), text.score_tokens("b")).alias("e")).collect()
    assert [r.e for r in got] == [1, 0]


def test_wilson_and_cosine(spark):
    lo, hi = stats.wilson("k", "n")
    rows = spark.createDataFrame([(0, 0), (155, 155)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert tuple(rows[0]) == (0.0, 0.0) and rows[1].hi == pytest.approx(1.0) and rows[1].lo == pytest.approx(0.976, abs=1e-3)
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(stats.cosine("a", "b").alias("c")).collect()
    assert [r.c for r in v] == [0.0, 1.0]


def test_clusters_and_bleu():
    assert learning.average_linkage([[1, 0], [1, 0.01], [0, 1]]) == [0, 0, 1]
    assert learning.bleu([(4, 4), (3, 3), (2, 2), (1, 1)], 4, 4) == pytest.approx(100)
    lo, hi, p = learning.bootstrap_interval([1.0] * 20, 200)
    assert lo == hi == 1.0 and p == 0.0
