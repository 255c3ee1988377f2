"""Queries that reconcile, mark and verify: votes, coverage, quotas, merges, audits of annotations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from .corpus import docs, positions
from .pairs import _P, _TOK, pairs, tokens
from .registry import query, table

#: Words that mark a language.
MARKERS = {"en": ["the", "and", "of"], "es": ["el", "los", "que"], "de": ["der", "und", "das"]}


def marker_counts(rows, words):
    """rows with one count of marker words for each language; words is an array of lower-case words."""
    count = lambda v: F.size(F.filter(words, lambda x: x.isin(v))).cast("long")
    return rows.withColumns({k: count(v) for k, v in MARKERS.items()})


def vote():
    """The language with the most markers; a tie is mixed, none is null."""
    top = F.greatest(*MARKERS)
    ties = sum((F.when(F.col(k) == top, 1).otherwise(0) for k in MARKERS), F.lit(0))
    named = F.coalesce(*(F.when(F.col(k) == top, k) for k in MARKERS))
    return F.when(top == 0, None).when(ties > 1, "mixed").otherwise(named)


_T = _TOK.format("text")
_M = f"m AS (SELECT doc_id, source, len({_T}) AS n, {', '.join(f'len(list_filter({_T}, lambda x: x IN ({chr(44).join(repr(w) for w in v)})))::BIGINT AS {k}' for k, v in MARKERS.items())} FROM documents)"
_VOTE = "CASE WHEN greatest(en, es, de) = 0 THEN NULL WHEN (en = greatest(en, es, de))::INT + (es = greatest(en, es, de))::INT + (de = greatest(en, es, de))::INT > 1 THEN 'mixed' WHEN en = greatest(en, es, de) THEN 'en' WHEN es = greatest(en, es, de) THEN 'es' ELSE 'de' END"


def _marked(spark, sf):
    return marker_counts(docs(spark, sf).select("doc_id", "source", tokens("text").alias("w")), F.col("w")).withColumn("n", F.size("w").cast("long")).drop("w")


@query(f"WITH {_M} SELECT coalesce(source, 'all') AS source, {_VOTE} AS vote, count(*) AS n FROM m GROUP BY GROUPING SETS ((source, 2), (2))")
def marker_vote(spark, sf):
    voted = _marked(spark, sf).withColumn("vote", vote()).groupBy("source", "vote").agg(F.count("*").alias("n"))
    total = voted.groupBy("vote").agg(F.sum("n").alias("n")).select(F.lit("all").alias("source"), "vote", "n")
    return voted.unionByName(total)


@query(f"WITH {_M} SELECT source, round(1000 * sum(en + es + de) / greatest(sum(n), 1), 6) AS rate, count_if(en + es + de > 0) AS marked FROM m GROUP BY 1")
def marker_rate(spark, sf):
    hits = F.col("en") + F.col("es") + F.col("de")
    return _marked(spark, sf).groupBy("source").agg(F.round(1000 * F.sum(hits) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("rate"), F.count_if(hits > 0).alias("marked"))


@query(f"""WITH {_M}, b AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS block FROM m),
g AS (SELECT block, count(*) AS n, sum(en) AS en, sum(es) AS es FROM b GROUP BY 1 HAVING sum(en) >= 10 AND sum(es) >= 10 AND sum(en) >= 2 * sum(es))
SELECT block::BIGINT AS block, n, en::BIGINT AS en, es::BIGINT AS es FROM g""")
def block_vote(spark, sf):
    """Blocks of rows by position count if both families of markers are there and one leads."""
    rows = positions(_marked(spark, sf), "doc_id").withColumn("block", F.floor(F.col("pos") / 50))
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("en").alias("en"), F.sum("es").alias("es")).where("en >= 10 AND es >= 10 AND en >= 2 * es")


@query(f"WITH t AS (SELECT unnest({_T}) AS token, lang FROM documents) SELECT token, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es FROM t GROUP BY 1")
def term_by_corpus(spark, sf):
    flat = docs(spark, sf).select(F.explode(tokens("text")).alias("token"), "lang")
    return flat.groupBy("token").agg(*(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")))


@query(f"""WITH t AS (SELECT unnest({_T}) AS token, lang FROM documents WHERE lang IN ('es', 'fr', 'de')), n AS (SELECT lang, count(*) AS total FROM t GROUP BY 1),
r AS (SELECT token, lang, 1e6 * count(*) / any_value(total) AS rate FROM t JOIN n USING (lang) GROUP BY 1, 2), e AS (SELECT * FROM r WHERE lang = 'es'), f AS (SELECT * FROM r WHERE lang = 'fr')
SELECT coalesce(e.token, f.token) AS token, round(greatest(coalesce(e.rate, 0), coalesce(f.rate, 0)), 6) AS veto FROM e FULL JOIN f ON e.token = f.token""")
def veto_rate(spark, sf):
    """The greater of a word's rates in two corpora; a word that one lacks counts zero there."""
    flat = docs(spark, sf).select("lang", F.explode(tokens("text")).alias("token"))
    rate = lambda x: _rates(flat.where(F.col("lang") == x)).withColumnRenamed("rate", x)
    both = rate("es").join(rate("fr"), "token", "full")
    return both.select("token", F.round(F.greatest(F.coalesce("es", F.lit(0.0)), F.coalesce("fr", F.lit(0.0))), 6).alias("veto"))


def _rates(flat):
    total = flat.agg(F.count("*").alias("total"))
    return flat.groupBy("token").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("token", stats.per_million("n", "total").alias("rate"))


@query(r"""WITH w AS (SELECT lang, string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(list_filter(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN regexp_matches(w[i - 1], '[.!?]$') THEN '' ELSE w[i] END), lambda x: regexp_matches(x, '^[A-Za-z]'))) AS x FROM w)
SELECT lang, count(*) AS n, count_if(regexp_matches(x, '^[A-Z]')) AS capital FROM p GROUP BY 1""")
def capital_inside(spark, sf):
    """Words with a capital that do not begin a sentence."""
    w = F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ")
    rows = docs(spark, sf).where("text IS NOT NULL").select("lang", w.alias("w"))
    inside = F.filter(F.zip_with(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), "w", lambda x, before: F.when(~before.rlike("[.!?]$"), x)), lambda x: x.rlike("^[A-Za-z]"))
    return rows.select("lang", F.explode(inside).alias("x")).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("x").rlike("^[A-Z]")).alias("capital"))


@query("SELECT lang, c AS letter, count(*) AS n, count(*) < 500 AS thin FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]')) AS c FROM documents) GROUP BY 1, 2")
def letter_coverage(spark, sf):
    """Letters by language, counted inside each text first so that the exchange carries one row a letter and partition."""
    flat = docs(spark, sf).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z])"), F.lit(1))).alias("letter"))
    return flat.groupBy("lang", "letter").agg(F.count("*").alias("n")).withColumn("thin", F.col("n") < 500)


@query("SELECT user_id, n, total, clean, rank() OVER (ORDER BY total DESC, user_id) AS place FROM (SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 4) AS clean FROM events GROUP BY 1 HAVING sum(value) >= 60) ORDER BY place LIMIT 8")
def eligible_rank(spark, sf):
    """Totals and clean totals of the first eight with enough; a top-k report."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.col("event_type") != "error", F.col("value")).otherwise(0.0)), 4).alias("clean"), F.sum("value").alias("s"))
    best = g.where("s >= 60").drop("s").orderBy(F.desc("total"), "user_id").limit(8)
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("total"), "user_id")).cast("long"))


@query("SELECT user_id, min_by(event_type, event_id) AS first_type FROM events GROUP BY 1")
def first_attribute(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5),
s AS (SELECT user_id, event_type, round(sum(value), 6) AS s FROM k GROUP BY 1, 2) SELECT user_id, event_type AS major, s AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type DESC) AS r FROM s) WHERE r = 1""")
def majority_attribute(spark, sf):
    """The attribute with the most weight among each group's five greatest rows."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    s = table(spark, sf, "events").withColumn("r", r).where("r <= 5").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("s"))
    return s.groupBy("user_id").agg(F.max_by("event_type", F.struct("s", "event_type")).alias("major"), F.max("s").alias("weight"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id, source, unnest({_T}) AS term FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY substr(source, 4)::INT, doc_id) AS r FROM t)
SELECT term, doc_id FROM r WHERE r <= CASE WHEN length(term) > 8 THEN 2 ELSE 14 END""")
def term_quota(spark, sf):
    """Rows that a term takes, sources in order: two of a rare kind, fourteen of others. Ranks stop early in each task."""
    t = docs(spark, sf).select("doc_id", F.expr("cast(substr(source, 4) AS int)").alias("at"), F.explode(F.array_distinct(tokens("text"))).alias("term"))
    r = F.row_number().over(Window.partitionBy("term").orderBy("at", "doc_id"))
    return t.withColumn("r", r).where("r <= 14").where(F.col("r") <= F.when(F.length("term") > 8, 2).otherwise(14)).select("term", "doc_id")


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, (pos % 3)::BIGINT AS reader, (((pos + n // 2) % n) % 3)::BIGINT AS second FROM p")
def second_reader(spark, sf):
    """The second reading starts half the list further on."""
    rows = positions(docs(spark, sf).select("doc_id"), "doc_id")
    n = rows.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n)).select("doc_id", (F.col("pos") % 3).alias("reader"), (((F.col("pos") + F.floor(F.col("n") / 2)) % F.col("n")) % 3).alias("second"))


@query("WITH h AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY hour) / sum(n) OVER (PARTITION BY event_type) AS c FROM h) SELECT event_type, min(hour)::BIGINT AS rolloff FROM c WHERE c >= 0.9 GROUP BY 1")
def rolloff(spark, sf):
    """Where a spectrum's running share first reaches nine tenths."""
    h = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    g = Window.partitionBy("event_type")
    c = h.withColumn("c", F.sum("n").over(g.orderBy("hour")) / F.sum("n").over(g))
    return c.where("c >= 0.9").groupBy("event_type").agg(F.min("hour").cast("long").alias("rolloff"))


_WORDSET = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"
_ES, _EN = ("[" + ", ".join(f"'{w}'" for w in MARKERS[k]) + "]" for k in ("es", "en"))


@query(f"""WITH {_P}, w AS (SELECT id, {_WORDSET.format("a")} AS a, {_WORDSET.format("b")} AS b FROM p)
SELECT id, len(a) > 0 AND ((NOT list_has_any(a, {_ES}) AND list_has_any(a, {_EN})) OR (len(b) > 0 AND len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE >= 0.8)) AS untranslated FROM w""")
def untranslated_side(spark, sf):
    """No marker of its language but one of the other's, or nearly the same words on both sides."""
    w = pairs(spark, sf).select("id", F.array_distinct(tokens("a")).alias("a"), F.array_distinct(tokens("b")).alias("b"))
    words = lambda k: F.array(*map(F.lit, MARKERS[k]))
    both = F.size(F.array_intersect("a", "b"))
    foreign = ~F.arrays_overlap("a", words("es")) & F.arrays_overlap("a", words("en"))
    same = (F.size("b") > 0) & (both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1)) >= 0.8)
    return w.select("id", ((F.size("a") > 0) & (foreign | same)).alias("untranslated"))


@query(r"""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN regexp_matches(text, '<[a-z]+') THEN 'tag-artifact' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no-letters'
WHEN length(trim(text)) < 30 THEN 'too-short' WHEN length(text) > 3000 THEN 'too-long' WHEN regexp_matches(lower(text), 'https?://|www[.]') THEN 'prose' ELSE 'kept' END AS reason FROM documents""")
def tag_rejection(spark, sf):
    low, n = F.lower("text"), F.length(F.trim("text"))
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("text").rlike("<[a-z]+"), "tag-artifact").when(~F.col("text").rlike("[A-Za-z]"), "no-letters")
    reason = reason.when(n < 30, "too-short").when(F.length("text") > 3000, "too-long").when(low.rlike("https?://|www[.]"), "prose").otherwise("kept")
    return docs(spark, sf).select("doc_id", reason.alias("reason"))


@query("""SELECT event_id, CASE WHEN value NOT BETWEEN 3 AND 300 THEN 'length' WHEN length(props) NOT BETWEEN 1 AND 300 THEN 'chars' WHEN regexp_matches(props, '[\\[\\]()]') THEN 'digits_or_brackets' WHEN (props->>'k')::INT < 10 THEN 'logprob' WHEN event_type = 'error' THEN 'no_speech' ELSE '' END AS reason FROM events""")
def segment_reason(spark, sf):
    """First reason of a pass over segments; the empty text is a pass."""
    v, k = F.col("value"), F.get_json_object("props", "$.k").cast("int")
    reason = F.when(~v.between(3, 300), "length").when(~F.length("props").between(1, 300), "chars").when(F.col("props").rlike(r"[\[\]()]"), "digits_or_brackets").when(k < 10, "logprob").when(F.col("event_type") == "error", "no_speech").otherwise("")
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic IS NULL OR toxic NOT IN (1)")
def unknown_kept(spark, sf):
    """A row goes only if its class is known and listed."""
    rows = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(F.col("toxic").isNull() | ~F.col("toxic").isin(1)).select("doc_id")


@query(r"""SELECT doc_id, regexp_full_match(coalesce(text, ''), '[A-Za-z .,;:!?''\n-]*') AS representable, NOT regexp_matches(coalesce(text, ''), '[@#\\{}]') AND length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= greatest(3, 0.6 * length(trim(coalesce(text, '')))) AS likely FROM documents""")
def charset_tests(spark, sf):
    t = F.coalesce("text", F.lit(""))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return docs(spark, sf).select("doc_id", t.rlike(r"\A[A-Za-z .,;:!?'\n-]*\z").alias("representable"), (~t.rlike(r"[@#\\{}]") & (letters >= F.greatest(F.lit(3.0), 0.6 * F.length(F.trim(t))))).alias("likely"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_T}) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM t WHERE length(w) >= 3 GROUP BY 1 HAVING count(*) >= 5)
SELECT doc_id, count(*) AS n, count(f.w) AS known, bool_and(f.w IS NOT NULL) AS all_known FROM t LEFT JOIN f USING (w) WHERE length(t.w) >= 3 GROUP BY 1""")
def known_words(spark, sf):
    t = docs(spark, sf).select("doc_id", F.explode(tokens("text")).alias("w")).where("length(w) >= 3").groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    known = t.groupBy("w").agg(F.sum("c").alias("n")).where("n >= 5").select("w", F.lit(True).alias("ok"))
    rows = t.join(known, "w", "left")
    return rows.groupBy("doc_id").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("c"))), F.lit(0)).alias("known"), F.every(F.coalesce("ok", F.lit(False))).alias("all_known"))


_READ = f"r AS (SELECT doc_id, list_transform({_T}, lambda x: {{'w': x, 'c': least(1.0, length(x) / 10.0)}}) AS regions FROM documents)"


def regions(spark, sf):
    """(doc_id, regions): words as read regions (w, c), the confidence c made of the length."""
    made = F.transform(tokens("text"), lambda x: F.struct(x.alias("w"), F.least(F.lit(1.0), F.length(x) / 10.0).alias("c")))
    return docs(spark, sf).select("doc_id", made.alias("regions"))


@query(f"""WITH {_READ} SELECT doc_id, CASE WHEN regions IS NULL OR len(regions) = 0 THEN 'unreadable' WHEN len(regions) < 5 THEN 'too few regions' WHEN len(list_filter(regions, lambda x: length(x.w) >= 3 AND x.c > 0.3)) < 2 THEN 'no wordy region' ELSE 'keep' END AS verdict,
coalesce(len(list_filter(regions, lambda x: x.c >= 0.5)), 0)::BIGINT AS sure FROM r""")
def region_verdict(spark, sf):
    r = F.coalesce("regions", F.expr("cast(array() AS array<struct<w: string, c: double>>)"))
    wordy = F.size(F.filter(r, lambda x: (F.length(x["w"]) >= 3) & (x["c"] > 0.3)))
    verdict = F.when(F.size(r) == 0, "unreadable").when(F.size(r) < 5, "too few regions").when(wordy < 2, "no wordy region").otherwise("keep")
    return regions(spark, sf).select("doc_id", verdict.alias("verdict"), F.size(F.filter(r, lambda x: x["c"] >= 0.5)).cast("long").alias("sure"))


@query(f"""WITH {_READ} SELECT doc_id, array_to_string(list_transform(list_filter(regions, lambda x: x.c >= 0.5 OR (x.c >= 0.3 AND x.c + 0.25 >= 0.6)), lambda x: x.w), ' ') AS text FROM r WHERE regions IS NOT NULL""")
def confidence_floor(spark, sf):
    """Regions under the floor stay if their second reading reaches it; the order is kept."""
    good = F.filter("regions", lambda x: (x["c"] >= 0.5) | ((x["c"] >= 0.3) & (x["c"] + 0.25 >= 0.6)))
    return regions(spark, sf).where("regions IS NOT NULL").select("doc_id", F.array_join(F.transform(good, lambda x: x["w"]), " ").alias("text"))


@query("SELECT u.id, CASE WHEN v.q > u.q + 0.10 THEN 'b' ELSE 'a' END AS reading FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount AS q FROM lineitem) u LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber + 1 AS id, l_discount + l_tax AS q FROM lineitem) v USING (id)")
def margin_pick(spark, sf):
    """Of two readings the second only if it is surer by a margin; one that is missing loses."""
    line = table(spark, sf, "lineitem")
    u = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_discount").alias("x"))
    v = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("id"), (F.col("l_discount") + F.col("l_tax")).alias("y"))
    return u.join(v, "id", "left").select("id", F.when(F.col("y") > F.col("x") + 0.10, "b").otherwise("a").alias("reading"))


@query("SELECT event_id FROM events WHERE (props->>'k') IS NOT NULL AND ((props->>'k') IN ('7', '29', '89') OR event_type = 'signup')")
def tag_predicate(spark, sf):
    """A tag map holds a key with a value, or a key of another set."""
    tags = F.from_json("props", "map<string, string>")
    k = F.try_element_at(tags, F.lit("k"))
    return table(spark, sf, "events").where(k.isNotNull() & (k.isin("7", "29", "89") | (F.col("event_type") == "signup"))).select("event_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') AND NOT regexp_matches(lower(text), '(^|[^a-z0-9_])der($|[^a-z0-9_])')")
def word_presence(spark, sf):
    low = F.lower("text")
    has = lambda w: low.rlike(f"(^|[^a-z0-9_]){w}($|[^a-z0-9_])")
    return docs(spark, sf).where(has("the") & ~has("der")).select("doc_id")


@query(f"""WITH {_P}, c AS (SELECT id, unnest({_TOK.format("a")}) AS w FROM p), x AS (SELECT id, w, count(*) AS n FROM c GROUP BY 1, 2), d AS (SELECT id, unnest({_TOK.format("b")}) AS w FROM p), y AS (SELECT id, w, count(*) AS n FROM d GROUP BY 1, 2),
o AS (SELECT DISTINCT x.id FROM x LEFT JOIN y ON x.id = y.id AND x.w = y.w WHERE x.n > coalesce(y.n, 0)) SELECT corpus, count(*) AS n, count_if(o.id IS NULL) AS contained FROM p LEFT JOIN o ON p.id = o.id GROUP BY 1""")
def multiset_contained(spark, sf):
    """Whether one side's words are all on the other, as often at least."""
    rows = pairs(spark, sf)
    side = lambda c, n: rows.select("id", F.explode(tokens(c)).alias("w")).groupBy("id", "w").agg(F.count("*").alias(n))
    over = side("a", "x").join(side("b", "y"), ["id", "w"], "left").where(F.col("x") > F.coalesce("y", F.lit(0))).select("id").distinct().withColumn("over", F.lit(True))
    return rows.join(over, "id", "left").groupBy("corpus").agg(F.count("*").alias("n"), F.count_if(F.col("over").isNull()).alias("contained"))


_GEO = "(SELECT s_suppkey AS id, ((s_suppkey * 37) % 1000) / 1000.0::DOUBLE + 44 AS lat, ((s_suppkey * 91) % 1000) / 1000.0::DOUBLE + 17 AS lon FROM supplier)"
_HAV = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f"SELECT a.id AS a, b.id AS b, round({_HAV}, 3) AS metres FROM {_GEO} a JOIN {_GEO} b ON a.id < b.id WHERE {_HAV} <= 5000")
def proximity_pairs(spark, sf):
    """Points within a radius: each is joined with its own and the neighbouring cells, then measured exactly."""
    at = lambda m: (F.col("s_suppkey") * m) % 1000 / 1000.0
    points = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (at(37) + 44).alias("lat"), (at(91) + 17).alias("lon"))
    return within(points, 5000.0).select("a", "b", F.round("metres", 3).alias("metres"))


def within(points, radius: float, top: float = 70.0):
    """(a, b, metres): pairs a < b of points (id, lat, lon) at most `radius` metres apart, between latitudes -top and top.

    Cells are as wide as the radius at the highest latitude, so a pair lies in neighbouring cells.
    """
    import math

    high = radius / 110_000
    wide = high / math.cos(math.radians(top))
    cell = points.withColumns({"cy": F.floor(F.col("lat") / high), "cx": F.floor(F.col("lon") / wide)})
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = cell.withColumn("dy", near).withColumn("dx", near).select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"))
    met = spread.join(cell, ["cy", "cx"]).where("a < id")
    half = lambda x, y: F.pow(F.sin(F.radians(F.col(y) - F.col(x)) / 2), F.lit(2))
    metres = 2 * 6371000 * F.asin(F.sqrt(half("la", "lat") + F.cos(F.radians("la")) * F.cos(F.radians("lat")) * half("lo", "lon")))
    return met.select("a", F.col("id").alias("b"), metres.alias("metres")).where(F.col("metres") <= radius)


_FORMS = "CASE WHEN list_has_any(w, ['the', 'and']) AND list_has_any(w, ['und', 'el']) THEN 'both' WHEN list_has_any(w, ['the', 'and']) THEN 'main' WHEN list_has_any(w, ['und']) AND list_has_any(w, ['el']) THEN 'both-alt' WHEN list_has_any(w, ['und']) THEN 'first' WHEN list_has_any(w, ['el']) THEN 'second' ELSE 'neither' END"


@query(f"SELECT source, {_FORMS} AS outcome, count(*) AS n FROM (SELECT source, coalesce({_T}, []) AS w FROM documents) GROUP BY 1, 2")
def outcome_counts(spark, sf):
    """Which forms of a choice a text writes; the order of the cases decides."""
    has = lambda *v: F.arrays_overlap("w", F.array(*map(F.lit, v)))
    rows = docs(spark, sf).select("source", F.coalesce(tokens("text"), F.expr("cast(array() AS array<string>)")).alias("w"))
    main, one, two = has("the", "and"), has("und"), has("el")
    outcome = F.when(main & (one | two), "both").when(main, "main").when(one & two, "both-alt").when(one, "first").when(two, "second").otherwise("neither")
    return rows.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(r"SELECT id, sum(least(length(regexp_replace(a, '[^' || c || ']', '', 'g')), length(regexp_replace(b, '[^' || c || ']', '', 'g'))))::BIGINT AS survived, sum(length(regexp_replace(a, '[^' || c || ']', '', 'g')))::BIGINT AS held FROM (WITH " + _P + " SELECT * FROM p), (SELECT unnest(['é', 'è', 'ü', 'ñ', 'ö']) AS c) GROUP BY 1")
def mark_survival(spark, sf):
    """Marked letters of one side that the other keeps, letter by letter."""
    times = lambda c, x: F.length(F.regexp_replace(c, f"[^{x}]", ""))
    marked = "éèüñö"
    survived = sum((F.least(times("a", x), times("b", x)) for x in marked), F.lit(0))
    return pairs(spark, sf).select("id", survived.cast("long").alias("survived"), sum((times("a", x) for x in marked), F.lit(0)).cast("long").alias("held"))


@query("SELECT p_partkey, f AS nearest, d::BIGINT AS edits FROM (SELECT p_partkey, f, levenshtein(p_type, f) AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(p_type, f), f) AS r FROM part, (SELECT unnest(['ECONOMY', 'STANDARD', 'PROMO', 'small', 'large']) AS f)) WHERE r = 1")
def nearest_form(spark, sf):
    """The nearest of a few listed forms by edit distance; ties go to the first in order."""
    forms = F.array(*map(F.lit, ["ECONOMY", "STANDARD", "PROMO", "small", "large"]))
    best = F.array_min(F.transform(forms, lambda f: F.struct(F.levenshtein("p_type", f).alias("d"), f.alias("f"))))
    return table(spark, sf, "part").select("p_partkey", best["f"].alias("nearest"), best["d"].cast("long").alias("edits"))
