import duckdb
import pytest

import __spark_entry__ as entry
from sievework.operators import checks, relational as rel
from sievework.plans import catalog
from sievework.sources import readers, writers
from sievework.streaming import events

SF = "/root/testdata/sf0.001"
NAMES = ["filter_report", "dedup_exact_keep_first", "rare_token_candidates", "shard_bounds", "pair_reasons", "association_dice", "label_cohesion", "budget_prefix", "session", "category_bfs", "star_rollup", "marker_vote", "block_vote", "term_quota", "proximity_pairs", "batch_merge", "gate_log", "contrast_mining", "lexical_coverage", "knn_topk", "progress_state"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert clean(catalog.queries()[name](spark, SF).select(*cols).collect()) == clean(want.fetchall())


def test_tsv_policies(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('c\ta "q\tb\nbad\trow\n')
    path = str(tmp_path / "x.tsv")
    assert [tuple(r) for r in readers.tsv(spark, path, ["source", "bs", "en"]).collect()] == [("c", 'a "q', "b")]
    assert readers.tsv(spark, path, ["source", "bs", "en"], "count").where("malformed").count() == 1
    with pytest.raises(Exception, match="expected source, bs, en"):
        readers.tsv(spark, path, ["source", "bs", "en"], "fail").collect()
    writers.tsv(spark.createDataFrame([("a", "b")], "x string, y string"), str(tmp_path / "out"))
    assert [r.text for r in readers.lines(spark, str(tmp_path / "out")).collect()] == ["a\tb"]
    with pytest.raises(Exception, match="holds a tab"):
        writers.tsv(spark.createDataFrame([("a\t",)], "x string"), str(tmp_path / "out2"))


def test_shard_union_finds_duplicates(spark):
    whole = spark.createDataFrame([(i, f"s{i}") for i in range(10)], "pos long, k string")
    bounds = spark.createDataFrame([(0, 4), (1, 3), (2, 3)], "shard long, size long")
    shards = whole.select(rel.balanced_bounds(whole["pos"], whole["pos"] * 0 + 10, 3).alias("shard"), "pos", "k")
    checks.gate(checks.shard_union(shards, whole, "k", bounds))
    with pytest.raises(checks.CheckFailed, match="duplicate_sources: 1"):
        checks.gate(checks.shard_union(shards.unionAll(shards.limit(1)), whole, "k", bounds))


def test_leak_strengths_count_sides_apart(spark):
    held = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "", "x"), (4, None, "d")], "id long, a string, b string")
    train = spark.createDataFrame([("a", "b"), ("c", "z"), ("y", "d"), ("", "q")], "a string, b string")
    got = {r.id: (r.pair, r.side_a, r.side_b) for r in rel.leak_strengths(held, train).collect()}
    assert got == {1: (True, False, False), 2: (False, True, True), 3: (False, False, False), 4: (False, False, True)}


def test_stream_counts_as_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), rows.schema, 10)
    got = events.drain(events.windowed(stream, late="60 days"), "w_counts", "complete")
    assert got.agg({"n": "sum"}).first()[0] == rows.count()


def test_checks_of_names_and_records(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "v string, k int")
    ok = lambda df: df.first()["ok"]
    assert ok(checks.same_records(a, b, "k", "same")) and not ok(checks.same_records(a, b.where("k = 1"), "k", "same"))
    assert checks.fingerprint(a) == checks.fingerprint(b.repartition(3)) != checks.fingerprint(a.union(a))
    assert ok(checks.matched_share(a, a, "k", "names")) and not ok(checks.matched_share(a.where("k = 1"), a, "k", "names")) and not ok(checks.matched_share(a, a.where("false"), "k", "names"))


def test_aligned_sides(spark, tmp_path):
    rows = [(i, f"a{i}", f"b{i}\nx" if i % 2 else None) for i in range(40)]
    writers.aligned(spark.createDataFrame(rows, "i int, bs string, en string"), str(tmp_path / "out"), "bs", "en", "i")
    read = lambda side: [line for f in sorted((tmp_path / "out" / f"side={side}").glob("*.txt")) for line in f.read_text().splitlines()]
    assert read("bs") == [r[1] for r in rows] and read("en") == [(r[2] or "").replace("\n", " ") for r in rows]
