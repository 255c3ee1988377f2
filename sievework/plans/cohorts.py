"""Queries that merge, assign and audit work, compare versions and arms, and mine contrasts between two sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import learning, numeric, resample
from .corpus import docs, positions
from .pairs import _ONLY, _P, _TOK, pairs, stemmed, tokens
from .registry import query, table


@query("""WITH k AS (SELECT doc_id AS k, 1 AS s FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2 FROM labels UNION ALL SELECT page_id, 4 FROM pages)
SELECT held, count(*) AS n FROM (SELECT k, sum(DISTINCT s)::BIGINT AS held FROM k GROUP BY 1) GROUP BY 1""")
def key_set_equality(spark, sf):
    """Keys by the sides that hold them; three equal sets leave the one class 7."""
    side = lambda name, key, s: table(spark, sf, name).select(F.col(key).alias("k"), F.lit(s).alias("s"))
    every = side("documents", "doc_id", 1).where("k % 2 = 0").unionByName(side("labels", "doc_id", 2)).unionByName(side("pages", "page_id", 4))
    return every.groupBy("k").agg(F.bit_or("s").cast("long").alias("held")).groupBy("held").agg(F.count("*").alias("n"))


_COHORT = "CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'listed' WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal > 5000 THEN 'rich' ELSE 'other' END"


@query(f"SELECT cohort, count(*) AS n, count(*) > 3 AS as_expected FROM (SELECT {_COHORT} AS cohort FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def cohort_histogram(spark, sf):
    """Ordered rules and a registry assign a cohort; the histogram is held against what was expected."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    cohort = F.when(F.col("r_name").isin("ASIA", "AFRICA"), "listed").when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") > 5000, "rich").otherwise("other")
    return rows.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n")).withColumn("as_expected", F.col("n") > 3)


@query("SELECT e.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS missing FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END AS doc_id FROM documents) e LEFT JOIN labels l ON e.doc_id = l.doc_id")
def alias_resolution(spark, sf):
    """A key goes through the map of redirects, then is looked up; what is missing is marked."""
    rows = docs(spark, sf).select("doc_id")
    moved = rows.where("doc_id % 10 = 3").select("doc_id", (F.col("doc_id") - 1).alias("to"))
    resolved = rows.join(moved, "doc_id", "left").select(F.coalesce("to", "doc_id").alias("doc_id"))
    found = resolved.join(table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("there")), "doc_id", "left")
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("there").isNull().alias("missing"))


@query("""WITH b AS (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT -doc_id, 0 FROM labels WHERE doc_id % 50 = 0 AND doc_id > 0),
g AS (SELECT k, count(*) AS n FROM b GROUP BY 1) SELECT 'duplicate' AS problem, count(*) AS n FROM g WHERE g.n > 1 UNION ALL SELECT 'missing', count(*) FROM labels WHERE doc_id NOT IN (SELECT k FROM g) UNION ALL SELECT 'unknown', count(*) FROM g WHERE k NOT IN (SELECT doc_id FROM labels)""")
def batch_merge(spark, sf):
    """Batches of answers against the rows that were drawn: answered twice, not at all, or never asked."""
    drawn = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), "quality")
    batches = drawn.where("k % 3 <> 0").select("k").unionByName(drawn.where("k % 7 = 0").select("k")).unionByName(drawn.where("k % 50 = 0 AND k > 0").select((-F.col("k")).alias("k")))
    g = batches.groupBy("k").agg(F.count("*").alias("n"))
    line = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    return line("duplicate", g.where("n > 1")).unionByName(line("missing", drawn.join(g, "k", "left_anti"))).unionByName(line("unknown", g.join(drawn, "k", "left_anti")))


@query("SELECT doc_id, 5 + (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unassigned_work(spark, sf):
    """What no batch has yet, in batches of 40 that go on from the last number."""
    left = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return positions(left, "doc_id").select("doc_id", (5 + F.floor(F.col("pos") / 40)).alias("batch"))


@query(f"""WITH {_P}, f AS (SELECT corpus, count(*) AS n, count_if(trim(b) = '') AS empty, count_if(a = b) AS copied, count_if(corpus NOT IN ('c0', 'c1')) AS unknown FROM p GROUP BY 1)
SELECT *, copied >= greatest(3, n / 10.0) AS machine, copied = n AS identical FROM f""")
def annotation_integrity(spark, sf):
    """A pass over rows is refused if too many equal the machine's words, or all."""
    f = pairs(spark, sf).groupBy("corpus").agg(F.count("*").alias("n"), F.count_if(F.trim("b") == "").alias("empty"), F.count_if(F.col("a") == F.col("b")).alias("copied"), F.count_if(~F.col("corpus").isin("c0", "c1")).alias("unknown"))
    return f.withColumn("machine", F.col("copied") >= F.greatest(F.lit(3.0), F.col("n") / 10)).withColumn("identical", F.col("copied") == F.col("n"))


@query("""WITH s AS (SELECT page_id, 2 * regexp_matches(lower(url), 'a')::INT + regexp_matches(lower(html), 'the')::INT AS score FROM pages)
SELECT page_id, score::BIGINT AS score, row_number() OVER (ORDER BY score DESC, md5('7' || page_id), page_id) AS place FROM s""")
def priority_order(spark, sf):
    """Shuffled by hash, then by score; the place of every row without one task for all."""
    score = 2 * F.lower("url").rlike("a").cast("long") + F.lower("html").rlike("the").cast("long")
    rows = table(spark, sf, "pages").select("page_id", score.alias("score"))
    rows = rows.withColumn("order", F.struct((-F.col("score")).alias("s"), F.md5(F.concat(F.lit("7"), F.col("page_id").cast("string"))).alias("h"), "page_id"))
    return positions(rows, "order").select("page_id", "score", (F.col("pos") + 1).alias("place"))


_GATE = "CASE WHEN html IS NULL THEN 'no-info' WHEN page_id % 11 = 0 THEN 'licence' WHEN contains(url, '?') THEN 'mime' WHEN length(html) < 200 THEN 'size' ELSE 'taken' END"


@query(f"""WITH g AS (SELECT page_id, {_GATE} AS gate FROM pages), r AS (SELECT *, sum((gate = 'taken')::INT) OVER (ORDER BY page_id) AS taken FROM g),
k AS (SELECT min(page_id) AS stop FROM r WHERE taken = 60) SELECT gate, count(*) AS n FROM g, k WHERE page_id <= coalesce(stop, page_id) GROUP BY 1""")
def gate_log(spark, sf):
    """Gates in order, stopping at the sixtieth taken: what was seen up to there, by gate."""
    gate = F.when(F.col("html").isNull(), "no-info").when(F.col("page_id") % 11 == 0, "licence").when(F.contains("url", F.lit("?")), "mime").when(F.length("html") < 200, "size").otherwise("taken")
    rows = table(spark, sf, "pages").select("page_id", gate.alias("gate"))
    # only the sixtieth taken number matters: a top-k over the taken, not a running sum over all
    stop = rows.where("gate = 'taken'").orderBy("page_id").limit(60).agg(F.max("page_id").alias("stop"), F.count("*").alias("taken"))
    return rows.join(F.broadcast(stop)).where("taken < 60 OR page_id <= stop").groupBy("gate").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS split, count(*) AS n, count_if(x IS DISTINCT FROM y) AS changed, round(avg(y - x), 6) AS delta FROM (SELECT o_orderkey AS k, o_orderpriority, round(o_totalprice) AS x FROM orders) JOIN (SELECT o_orderkey AS k, round(o_totalprice) + (o_orderkey % 4) - 1 AS y FROM orders) USING (k) GROUP BY 1")
def version_diff(spark, sf):
    """Two versions of a build by key: rows that changed, and how far scores moved, by split."""
    o = table(spark, sf, "orders")
    before = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("split"), F.round("o_totalprice").alias("x"))
    after = o.select(F.col("o_orderkey").alias("k"), (F.round("o_totalprice") + F.col("o_orderkey") % 4 - 1).alias("y"))
    return before.join(after, "k").groupBy("split").agg(F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("delta"))


_MISS = f"{_P}, x AS (SELECT id, corpus, unnest(list_distinct({_TOK.format('a')})) AS w, list_distinct({_TOK.format('b')}) AS y FROM p), m AS (SELECT corpus, w, count(*) AS asked, count_if(NOT list_contains(y, w)) AS missed FROM x GROUP BY 1, 2)"


@query(f"WITH {_MISS} SELECT corpus, w, asked, missed FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY missed DESC, asked, w) AS r FROM m) WHERE r <= 10")
def most_missed(spark, sf):
    """The ten words of an arm that are missed most."""
    x = pairs(spark, sf).select("corpus", F.explode(F.array_distinct(tokens("a"))).alias("w"), tokens("b").alias("y"))
    m = x.groupBy("corpus", "w").agg(F.count("*").alias("asked"), F.count_if(~F.array_contains("y", F.col("w"))).alias("missed"))
    r = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("missed"), "asked", "w"))
    return m.withColumn("r", r).where("r <= 10").select("corpus", "w", "asked", "missed")


@query(f"WITH {_P}, w AS (SELECT corpus, {_TOK.format('a')} AS x, {_TOK.format('b')} AS y FROM p) SELECT corpus, round(avg((x = y)::INT), 6) AS same, round(avg((list_sort(x) = list_sort(y))::INT), 6) AS same_words FROM w GROUP BY 1")
def sequence_agreement(spark, sf):
    w = pairs(spark, sf).select("corpus", tokens("a").alias("x"), tokens("b").alias("y"))
    return w.groupBy("corpus").agg(F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("same"), F.round(F.avg((F.sort_array("x") == F.sort_array("y")).cast("int")), 6).alias("same_words"))


@query("""WITH c AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzß', '')) AS c), h AS (SELECT DISTINCT lang, c FROM documents JOIN c ON contains(lower(text), c)), l AS (SELECT DISTINCT lang FROM documents)
SELECT l.lang, count(*) AS n, string_agg(c.c, '' ORDER BY c.c) AS missing FROM l JOIN c ON true LEFT JOIN h ON h.lang = l.lang AND h.c = c.c WHERE h.c IS NULL GROUP BY 1""")
def symbol_coverage(spark, sf):
    """Symbols that must occur and do not, by language: each text says which it holds, and those are joined by bits."""
    symbols = "abcdefghijklmnopqrstuvwxyzß"
    low = F.lower("text")
    held = sum((F.when(F.contains(low, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(symbols)), F.lit(0)).cast("long")
    by = docs(spark, sf).groupBy("lang").agg(F.bit_or(held).alias("bits"))
    missing = F.concat_ws("", *(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) == 0, c) for i, c in enumerate(symbols)))
    return by.select("lang", missing.alias("missing")).where("missing <> ''").select("lang", F.length("missing").cast("long").alias("n"), "missing")


@query("SELECT doc_id, CASE WHEN regexp_matches(l, '[A-Z]') AND NOT regexp_matches(l, '[a-z]') THEN 'recased' WHEN regexp_matches(l, '[^\\x00-\\x7F]') THEN 'foreign' ELSE 'calm' END AS kind, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2")
def line_class(spark, sf):
    line = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    kind = F.when(F.col("l").rlike("[A-Z]") & ~F.col("l").rlike("[a-z]"), "recased").when(F.col("l").rlike(r"[^\x00-\x7F]"), "foreign").otherwise("calm")
    return line.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n, max(ts) AS beat FROM events GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS done, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d)
SELECT user_id, day::VARCHAR AS day, round(least(100, 100 * done / 80.0), 4) AS percent, CASE WHEN done >= 80 THEN 'done' WHEN before IS NULL THEN 'waiting' WHEN date_diff('day', before, day) > 2 THEN 'stalled' ELSE 'running' END AS state FROM s""")
def progress_state(spark, sf):
    """Progress towards 80 by day, and a state from the counter and the age of the beat before."""
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    s = d.withColumns({"done": F.sum("n").over(w), "before": F.lag("day").over(w)})
    state = F.when(F.col("done") >= 80, "done").when(F.col("before").isNull(), "waiting").when(F.datediff("day", "before") > 2, "stalled").otherwise("running")
    return s.select("user_id", F.col("day").cast("string").alias("day"), F.round(F.least(F.lit(100.0), 100 * F.col("done") / 80.0), 4).alias("percent"), state.alias("state"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 32 AS batch FROM documents")
def length_batches(spark, sf):
    """Rows of like lengths together, 32 to a batch; the number of the row restores the order."""
    rows = docs(spark, sf).select("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("order"))
    return positions(rows, "order").select("doc_id", F.floor(F.col("pos") / 32).alias("batch"))


@query("SELECT id, CASE WHEN md5('5' || id) < '8' THEN 'a' ELSE 'b' END AS first FROM (WITH " + _P + " SELECT * FROM p)")
def blind_assignment(spark, sf):
    return pairs(spark, sf).select("id", F.when(F.md5(F.concat(F.lit("5"), F.col("id").cast("string"))) < "8", "a").otherwise("b").alias("first"))


@query("WITH f AS (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS floor), r AS (SELECT floor, count_if(l_discount * 10 >= floor) / count(*)::DOUBLE AS recall FROM lineitem, f GROUP BY 1) SELECT max(floor) AS floor FROM r WHERE recall >= 0.5")
def threshold_choice(spark, sf):
    """The highest of listed floors that keeps the recall, in one pass."""
    floors = [0.1, 0.3, 0.5, 0.7]
    got = table(spark, sf, "lineitem").agg(*(F.avg((F.col("l_discount") * 10 >= f).cast("double")).alias(f"r{i}") for i, f in enumerate(floors)))
    return got.select(F.greatest(*(F.when(F.col(f"r{i}") >= 0.5, f) for i, f in enumerate(floors))).alias("floor"))


@query(f"""WITH {_P}, s AS (SELECT id, a, b FROM p), x AS (SELECT id, list_filter(string_split(a, '. '), lambda v: trim(v) <> '') AS u, list_filter(string_split(b, '. '), lambda v: trim(v) <> '') AS v FROM s),
k AS (SELECT id, u, v, unnest(range(1, len(u) + 1)) AS i FROM x WHERE len(u) = len(v)) SELECT id, i::BIGINT AS i, md5(u[i]) AS a, md5(v[i]) AS b FROM k""")
def aligned_split(spark, sf):
    """Rows whose sides split into as many sentences become that many rows; others go."""
    split = lambda c: F.filter(F.split(c, r"\. ", -1), lambda v: F.trim(v) != "")
    x = pairs(spark, sf).select("id", split("a").alias("u"), split("b").alias("v")).where("size(u) = size(v)")
    return x.select("id", F.posexplode(F.arrays_zip("u", "v"))).select("id", (F.col("pos") + 1).cast("long").alias("i"), F.md5("col.u").alias("a"), F.md5("col.v").alias("b"))


@query(r"SELECT doc_id, len(t)::BIGINT AS pieces, array_to_string(t, '') = text AS whole FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \n]+|[ \n]+') AS t FROM documents WHERE text IS NOT NULL)")
def token_scan(spark, sf):
    """Tokens with all between them: joined they are the text."""
    t = F.regexp_extract_all("text", F.lit(r"([A-Za-z]+|[0-9]+|[^A-Za-z0-9 \n]+|[ \n]+)"), F.lit(1))
    rows = docs(spark, sf).where("text IS NOT NULL").select("doc_id", "text", t.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("pieces"), (F.array_join("t", "") == F.col("text")).alias("whole"))


@query("SELECT vec_id, round(list_min(c)::DOUBLE * 2) AS low, round(list_max(c)::DOUBLE * 2) AS high FROM (SELECT vec_id, embedding[1:4] AS c FROM embeddings)")
def corner_bounds(spark, sf):
    """Bounds of a polygon's corners, scaled back and rounded."""
    c = F.slice("embedding", 1, 4)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.array_min(c).cast("double") * 2).alias("low"), F.round(F.array_max(c).cast("double") * 2).alias("high"))


@query("SELECT score, count(*) AS n, CASE WHEN count(*) < 5 THEN NULL ELSE score END AS counted FROM (SELECT least(CASE WHEN s_acctbal < 0 THEN 1 WHEN s_acctbal < 3000 THEN 2 WHEN s_acctbal < 7000 THEN 3 ELSE 4 END, CASE WHEN s_suppkey % 5 = 0 THEN 1 WHEN s_suppkey % 5 < 3 THEN 3 ELSE 5 END)::BIGINT AS score FROM supplier) GROUP BY 1")
def rubric_bands(spark, sf):
    """Bands give a score, the worse of two rubrics counts, and a class under five is void."""
    bal, key = F.col("s_acctbal"), F.col("s_suppkey") % 5
    score = F.least(F.when(bal < 0, 1).when(bal < 3000, 2).when(bal < 7000, 3).otherwise(4), F.when(key == 0, 1).when(key < 3, 3).otherwise(5)).cast("long")
    return table(spark, sf, "supplier").groupBy(score.alias("score")).agg(F.count("*").alias("n")).withColumn("counted", F.when(F.col("n") >= 5, F.col("score")))


@query(f"""WITH {_ONLY}, t2 AS (SELECT (SELECT count(*) FROM o) AS n), r AS (SELECT x, y, n, n / seen_x::DOUBLE AS fa, n / seen_y::DOUBLE AS ra, 2 * n / (seen_x + seen_y)::DOUBLE AS dice FROM c JOIN sx USING (x) JOIN sy USING (y) WHERE n >= 3),
f AS (SELECT x, y, n, dice FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(dice, 9) DESC, round(fa, 9) DESC, levenshtein(x, y), y) AS k FROM r WHERE fa >= 0.05 AND dice >= 0.05) WHERE k = 1),
b AS (SELECT x AS bx, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(dice, 9) DESC, round(ra, 9) DESC, levenshtein(x, y), x) AS k FROM r WHERE ra >= 0.05 AND dice >= 0.05) WHERE k = 1)
SELECT f.x, f.y, f.n, round(f.dice, 6) AS dice, CASE WHEN bx IS NOT NULL AND NOT (bx = f.x OR (length(bx) >= 5 AND length(f.x) >= 5 AND substr(bx, 1, 5) = substr(f.x, 1, 5) AND abs(length(bx) - length(f.x)) <= 3)
  OR (least(length(bx), length(f.x)) >= 3 AND abs(length(bx) - length(f.x)) <= 1 AND (starts_with(bx, f.x) OR starts_with(f.x, bx)))) THEN 'reverse differs' ELSE 'admitted' END AS verdict FROM f LEFT JOIN b ON b.y = f.y""")
def contrast_mining(spark, sf):
    """Best counterparts in both directions; a pair whose reverse names another word is refused."""
    only = stemmed(spark, sf).select(F.array_except("x", "y").alias("xs"), F.array_except("y", "x").alias("ys"))
    return learning.contrasts(learning.association(only, "xs", "ys"), 3, 0.05, 0.05).select("x", "y", "n", F.round("dice", 6).alias("dice"), "verdict")


@query(f"""WITH {_P}, t AS (SELECT id, list_distinct({_TOK.format('a')}) AS x, list_distinct({_TOK.format('b')}) AS y FROM p), fx AS (SELECT w, count(*) AS n FROM (SELECT unnest(y) AS w FROM t) GROUP BY 1 HAVING count(*) >= 5),
e AS (SELECT id, x, unnest(y) AS w FROM t) SELECT id, count(*) AS scoreable, round(CASE WHEN count(*) >= 5 THEN count_if(list_contains(x, w)) / count(*)::DOUBLE END, 6) AS coverage, coalesce(CASE WHEN count(*) >= 5 THEN count_if(list_contains(x, w)) / count(*)::DOUBLE END < 0.15, false) AS dropped FROM e JOIN fx USING (w) GROUP BY 1""")
def lexical_coverage(spark, sf):
    """Scoreable words of one side that the other holds; under five the pair abstains."""
    t = pairs(spark, sf).select("id", F.array_distinct(tokens("a")).alias("xs"), F.array_distinct(tokens("b")).alias("ys"))
    none = spark.createDataFrame([], "x string, y string, p double")
    scored = learning.coverage(t, "xs", "ys", none, frequent=5, least=5)
    return scored.select("id", "scoreable", F.round("coverage", 6).alias("coverage"), F.coalesce(F.col("coverage") < 0.15, F.lit(False)).alias("dropped"))


@query()
def pair_verdict(spark, sf):
    """Numbers disagree, one side was never translated, words do not correspond: first verdict wins. Greedy number comparison has no SQL."""
    rows = pairs(spark, sf)
    t = rows.select("id", F.array_distinct(tokens("a")).alias("xs"), F.array_distinct(tokens("b")).alias("ys"))
    trusted = t.where("size(xs) BETWEEN 1 AND 45 AND size(ys) BETWEEN 1 AND 45")  # as many words as a row of the table's training may have
    scored = learning.coverage(t, "xs", "ys", learning.translation_table(trusted, "xs", "ys", 2), frequent=5, least=5)
    odd = numeric.numbers_disagree(text.numeric_values("a"), text.numeric_values("b"))
    verdict = F.when(odd, "numbers_disagree").when(text.jaccard(tokens("a"), tokens("b")) >= 0.8, "not_translated").when(F.col("coverage") < 0.15, "words_do_not_correspond").otherwise("kept")
    return rows.join(scored, "id", "left").select("id", verdict.alias("verdict"), F.round("coverage", 6).alias("coverage"))


@query()
def word_families(spark, sf):
    """Forms grouped under the shortest that shares a prefix and a counterpart; greedy inside each prefix."""
    only = stemmed(spark, sf).select(F.array_except("x", "y").alias("xs"), F.array_except("y", "x").alias("ys"))
    found = learning.contrasts(learning.association(only, "xs", "ys"), 2, 0.0, 0.0)
    return learning.families(found.where("verdict = 'admitted'").select(F.col("x").alias("word"), F.col("y").alias("other")))


@query(f"""WITH t AS (SELECT unnest({_TOK.format('text')}) AS w FROM documents), f AS MATERIALIZED (SELECT w, count(*) AS n FROM t GROUP BY 1),
c AS MATERIALIZED (SELECT w, n, regexp_replace(w, 'ie', 'e') AS alt FROM f WHERE n >= 3 AND length(w) >= 4 AND contains(w, 'ie') AND NOT regexp_matches(w, 'ie$')) SELECT c.w AS form, c.alt, c.n, f.n AS attested FROM c JOIN f ON f.w = c.alt WHERE f.n >= 2""")
def alternation_candidates(spark, sf):
    """Forms that a spelling rule turns into another one that is attested."""
    f = docs(spark, sf).select(F.explode(tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    c = f.where("n >= 3 AND length(w) >= 4").where(F.contains("w", F.lit("ie")) & ~F.col("w").endswith("ie"))
    c = c.select(F.col("w").alias("form"), F.regexp_replace("w", "^(.*?)ie", "$1e").alias("alt"), "n")
    return c.join(f.select(F.col("w").alias("alt"), F.col("n").alias("attested")), "alt").where("attested >= 2").select("form", "alt", "n", "attested")


@query()
def chrf_stats(spark, sf):
    """Sufficient statistics of the character F-score, orders 1 to 6, white space aside."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda x: x != "")
    return learning.ngram_matches(pairs(spark, sf).select("id", chars("b").alias("hyp"), chars("a").alias("ref")), "hyp", "ref", 6)


@query()
def bootstrap_ci(spark, sf):
    """Interval and p of the mean gap between two arms, documents resampled by source; draws depend on the seed."""
    rows = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    stats = rows.groupBy(F.col("source").alias("cluster")).agg(F.sum((F.col("quality") - F.col("toxic")).cast("double")).alias("num"), F.count("*").cast("double").alias("den"))
    return resample.ratio_interval(stats, "cluster", "num", "den")


@query()
def power_table(spark, sf):
    """How often a planted difference is found, by its size; draws depend on the seed."""
    targets = table(spark, sf, "labels").agg(F.count("*").alias("n"))
    return resample.power(targets, [0.05, 0.10, 0.15, 0.20, 0.30])


@query()
def threshold_components(spark, sf):
    """Average-linkage clusters of each label's vectors, named by label and least vec_id."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vector"))
    found = learning.linked_clusters(rows)
    return found.select(F.col("id").alias("vec_id"), F.concat_ws("-", F.col("part").cast("string"), F.col("cluster").cast("string")).alias("cluster"))
