"""Stages in turn against what the operators say of each stage's input."""

import corpus_pipeline
from sievework.llm import decontam, quality, shared, simhash


def test_stages_take_effect(spark, tmp_path, docs, rows):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "needle in a hay stack that is long enough to find")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.materialize(stage(spark, now, sf), name)
        assert after.columns == docs.columns
        if name == "quality_rules":
            assert after.count() == quality.assess(now).where("kept").count()
        if name == "near_dedup":
            found = simhash.near_duplicates(now).where("doc_id IS NOT NULL")
            assert after.where("doc_id IS NOT NULL").count() == found.select("component_id").distinct().count()
        if name == "decontaminate":
            gone = decontam.decontaminate(now, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
            assert gone.count() == 1 and after.count() == now.count() - 1
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
    assert [stage(spark, docs.limit(0), sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_decontaminate_removes_rows_not_numbers(spark, tmp_path):
    bad = "needle in a hay stack that is long enough to find"
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, bad), (None, "clean one"), (5, "so " + bad), (5, "clean two"), (6, "clean three")]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), str(tmp_path))
    assert {r.text for r in got.collect()} == {"clean one", "clean two", "clean three"}


def test_columns_that_clash(spark, tmp_path):
    bad = "needle in a hay stack that is long enough to find"
    long = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["gone", "hit", "row", "n_lines", "kept_text", "keys_", "doc_", "row_", "gone_", "c0", "c1", "n_dropped", "k", "t", "kept", "n_words", "shard", "sequence_id", "offset"]
    shown = "a common line of text\n"
    texts = [long("a"), long("a") + " x", shown + long("b"), shown + long("c"), long("d") + " " + bad, long("a")]
    rows = [(k, t, *(f"{c}{k}" for c in extra)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)).repartition(2)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = shared.materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    got = {r.doc_id: r for r in now.collect()}
    assert {k: r.text for k, r in got.items()} == {0: texts[0], 2: texts[2], 3: long("c"), 5: ""}  # all lines of 5 are in 0
    assert all(r[c] == f"{c}{k}" for k, r in got.items() for c in extra)
    assert corpus_pipeline.pack(spark, now, str(tmp_path)).select("doc_id").distinct().count() == 4


def test_contents_after_line_dedup_and_packing(spark, docs, rows):
    from collections import Counter

    from test_operators import ids_of, kept_lines

    after = corpus_pipeline.line_dedup(spark, docs, "")
    assert Counter(map(tuple, after.select("doc_id", "text").collect())) == Counter((i, t) for i, _, _, t in kept_lines(rows))
    assert after.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack(spark, docs, "").groupBy("doc_id").sum("length").collect()
    want = Counter()
    for i, t in rows:
        want[i] += len(ids_of(t, 1))
    assert dict(map(tuple, packed)) == dict(want)


def test_scratch_deletes_what_is_not_kept(spark):
    with shared.scratch(spark) as keep:
        one, two = (shared.materialize(spark.range(3), "scratch") for _ in range(2))
        keep(two)
    assert two.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one._shared_path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_cluster_without_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    unset = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.work_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
