"""Queries that choose and label rows, follow corrections, search vectors and score arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import learning, resample
from .corpus import docs
from .pairs import _P, _TOK, pairs, tokens
from .registry import query, table

_V = "list_transform(embedding, lambda v: v::DOUBLE)"


@query(f"""WITH c AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine FROM (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id % 20 = 0) q JOIN (SELECT vec_id, {_V} AS v FROM embeddings) r ON q.vec_id <> r.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM c) WHERE place <= 10""")
def knn_topk(spark, sf):
    """The ten nearest rows of every row whose number is divisible by 20, against all rows."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return learning.nearest(e.where("id % 20 = 0"), e, 10)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'https?://|copyright') THEN 'overlay' WHEN length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) < 40 THEN 'short'
WHEN quality = 0 THEN 'lowconf' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def label_filter(spark, sf):
    t = F.coalesce("text", F.lit(""))
    rows = docs(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.lower(t).rlike("https?://|copyright"), "overlay").when(F.length(F.regexp_replace(t, "[^A-Za-z]", "")) < 40, "short").when(F.col("quality") == 0, "lowconf").otherwise("kept")
    return rows.select("doc_id", reason.alias("reason"))


@query("""SELECT CASE WHEN lang = 'fr' THEN 'class' WHEN source IN ('src1', 'src2') THEN 'licence' WHEN quality = 1 THEN 'scored' WHEN p.page_id IS NOT NULL THEN 'crop-source' ELSE 'pool' END AS reason, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id GROUP BY 1""")
def pool_exclusion(spark, sf):
    """Why a row is not in the pool: its class, its licence, it has been scored, or another set took it."""
    rows = docs(spark, sf).select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.join(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("cropped")), "doc_id", "left")
    reason = F.when(F.col("lang") == "fr", "class").when(F.col("source").isin("src1", "src2"), "licence").when(F.col("quality") == 1, "scored").when(F.col("cropped"), "crop-source").otherwise("pool")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({_TOK.format('text')}) AS w FROM documents) GROUP BY 1, 2), a AS (SELECT w, n FROM f WHERE lang = 'es' AND n >= 5), b AS (SELECT w, n FROM f WHERE lang = 'fr')
SELECT a.w AS form, CASE WHEN b.w IS NULL THEN 'no counterpart' WHEN b.n = a.n THEN 'same form' WHEN b.n > a.n THEN 'nested' ELSE 'kept' END AS verdict FROM a LEFT JOIN b USING (w)""")
def form_audit(spark, sf):
    """Each form of one side held against the other: the first verdict that fits."""
    f = docs(spark, sf).select("lang", F.explode(tokens("text")).alias("form")).where("lang IN ('es', 'fr')").groupBy("form").agg(F.count_if(F.col("lang") == "es").alias("a"), F.count_if(F.col("lang") == "fr").alias("b"))
    verdict = F.when(F.col("b") == 0, "no counterpart").when(F.col("b") == F.col("a"), "same form").when(F.col("b") > F.col("a"), "nested").otherwise("kept")
    return f.where("a >= 5").select("form", verdict.alias("verdict"))


@query(f"""WITH {_P}, x AS (SELECT DISTINCT id, unnest({_TOK.format('a')}) AS term FROM p), t(term, other) AS (VALUES ('the', 'is'), ('and', 'of'), ('der', 'die'), ('el', 'la'), ('le', 'la'))
SELECT x.id, term, other FROM x JOIN t USING (term) JOIN p ON p.id = x.id WHERE NOT list_contains({_TOK.format('b')}, other)""")
def target_building(spark, sf):
    """One target for each row and term, none where the other side has the alternative as well."""
    terms = spark.createDataFrame([("the", "is"), ("and", "of"), ("der", "die"), ("el", "la"), ("le", "la")], "term string, other string")
    x = pairs(spark, sf).select("id", F.explode(F.array_distinct(tokens("a"))).alias("term"), tokens("b").alias("held"))
    return x.join(F.broadcast(terms), "term").where(~F.array_contains("held", F.col("other"))).select("id", "term", "other")  # the terms are five constants


@query("SELECT doc_id, md5(text) AS form FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def first_per_text(spark, sf):
    rows = docs(spark, sf).where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.min(F.md5("text")).alias("form"))
    return rows.select("doc_id", "form")


@query("SELECT conv_id, CASE WHEN ('0x' || substr(md5('41:' || conv_id), 1, 8))::BIGINT < 0.8 * 4294967296 THEN 'train' ELSE 'valid' END AS split, count(*) AS turns FROM conversations GROUP BY 1")
def pair_split(spark, sf):
    """Four fifths by hash of the group, so that both sides of a pair stay together."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit("41:"), F.col("conv_id").cast("string"))), 1, 8), 16, 10).cast("long")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return g.select("conv_id", F.when(share < 0.8 * 4294967296, "train").otherwise("valid").alias("split"), "turns")


@query("""WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT user_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status FROM s WHERE r = 1""")
def corrections_status(spark, sf):
    """An append-only log: the last status of each correction; approved ones are exported."""
    log = table(spark, sf, "events").where("event_type IN ('signup', 'purchase', 'error')")
    last = log.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    return last.select("user_id", F.when(F.col("t") == "purchase", "approved").when(F.col("t") == "error", "rejected").otherwise("pending").alias("status"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 = 0), o AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT CASE WHEN o_orderkey IS NULL THEN 'not found' WHEN l_quantity > 45 THEN 'length' WHEN o_orderstatus = 'P' THEN 'owner' ELSE 'found' END AS result, count(*) AS n FROM w LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY 1""")
def selection_check(spark, sf):
    """Each selected row is there, with the owner and the length that the selection names; by result."""
    w = table(spark, sf, "lineitem").where("l_orderkey % 7 = 0").select("l_orderkey", "l_quantity")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    result = F.when(F.col("o_orderkey").isNull(), "not found").when(F.col("l_quantity") > 45, "length").when(F.col("o_orderstatus") == "P", "owner").otherwise("found")
    return w.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(result.alias("result")).agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, c AS (SELECT id, corpus, 'reference' AS control, a, a AS b FROM p UNION ALL SELECT id, corpus, 'copy', a, lower(a) FROM p UNION ALL SELECT id, corpus, 'empty', a, '' FROM p UNION ALL SELECT id, corpus, 'other', a, b FROM p)
SELECT control, count(*) AS n, round(avg(len(list_intersect({_TOK.format('a')}, {_TOK.format('b')})) / greatest(1, len(list_distinct({_TOK.format('a')})))::DOUBLE), 6) AS score FROM c GROUP BY 1""")
def control_rows(spark, sf):
    """The scorer's own checks: a side against itself, a copy, nothing, and its pair, through one plan."""
    both = {"reference": F.col("a"), "copy": F.lower("a"), "empty": F.lit(""), "other": F.col("b")}
    controls = F.explode(F.array(*(F.struct(F.lit(k).alias("control"), v.alias("b")) for k, v in both.items()))).alias("c")
    rows = pairs(spark, sf).select(tokens("a").alias("x"), controls).select("x", "c.control", tokens("c.b").alias("y"))
    score = F.size(F.array_intersect("x", "y")) / F.greatest(F.lit(1), F.size(F.array_distinct("x")))
    return rows.groupBy("control").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score"))


@query("""SELECT event_type, to_json({'arm': event_type, 'n': count(*), 'users': count(DISTINCT user_id), 'passed': count(*) > 100})::VARCHAR AS record FROM events GROUP BY 1""")
def gate_document(spark, sf):
    """A gate's figures of each arm as one document."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return g.select("event_type", F.to_json(F.struct(F.col("event_type").alias("arm"), "n", "users", (F.col("n") > 100).alias("passed"))).alias("record"))


@query("SELECT 'prefix' AS name, count_if(p.k IS DISTINCT FROM f.k) = 0 AS ok FROM (SELECT vec_id AS k, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings QUALIFY r <= 50) p JOIN (SELECT vec_id AS k, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings QUALIFY r <= 20) f USING (r)")
def frozen_prefix(spark, sf):
    """A longer sample begins with the frozen one; both are top-k reads of one hash order."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.md5(F.col("vec_id").cast("string")).alias("h"))
    w = Window.orderBy("h", "k")
    first = lambda n, name: e.orderBy("h", "k").limit(n).select(F.col("k").alias(name), F.row_number().over(w).alias("r"))
    both = first(50, "p").join(first(20, "f"), "r")
    return both.agg(F.count_if(~F.col("p").eqNullSafe(F.col("f"))).alias("n")).select(F.lit("prefix").alias("name"), (F.col("n") == 0).alias("ok"))


@query()
def wer_by_cohort(spark, sf):
    """Word error rate by overlapping cohorts: 1 and 2, 1 and 3, all. Word distances have no SQL."""
    rows = pairs(spark, sf).select("corpus", text.score_tokens("a").alias("ref"), text.score_tokens("b").alias("hyp"))
    cohort = {"1-2": ["c0", "c1"], "1-3": ["c0", "c2"], "all": ["c0", "c1", "c2"]}
    named = F.filter(F.array(*(F.when(F.col("corpus").isin(v), k) for k, v in cohort.items())), lambda x: x.isNotNull())
    scored = rows.select(named.alias("in"), F.size("ref").alias("words"), text.word_edits("ref", "hyp").alias("edits")).select(F.explode("in").alias("cohort"), "words", "edits")
    g = scored.groupBy("cohort").agg(F.sum("words").alias("words"), F.sum("edits").alias("edits"))
    return g.withColumn("wer", F.when(F.col("words") > 0, F.round(100 * F.col("edits") / F.col("words"), 6)))


@query()
def bleu_by_corpus(spark, sf):
    rows = pairs(spark, sf).select("corpus", learning.bleu_row(tokens("b"), tokens("a")).alias("s"))
    return rows.groupBy("corpus").agg(*learning.bleu_sums("s")).select("corpus", F.round(learning.bleu_of("s"), 6).alias("bleu"))


@query()
def bleu_significance(spark, sf):
    """Two arms on the same rows: one writes the pair's other side, one the same without its last word."""
    rows = pairs(spark, sf).select("id", tokens("a").alias("ref"), tokens("b").alias("y"))
    cut = F.slice("y", 1, F.greatest(F.size("y") - 1, F.lit(0)))
    return resample.bleu_gap(rows.select("id", learning.bleu_row(cut, "ref").alias("s"), learning.bleu_row("y", "ref").alias("t")), "id", "s", "t")
