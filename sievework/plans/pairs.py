"""Queries over parallel pairs (a user's turn and the assistant's next), word mining and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import learning, relational as rel
from .registry import query, table


def pairs(spark, sf):
    """(id, corpus, a, b): each user turn with the assistant turn that follows it."""
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    v = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("b"))
    return u.join(v, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("corpus"), "a", "b")


_P = """p AS (SELECT u.conv_id * 1000 + v.turn AS id, 'c' || (u.conv_id % 3) AS corpus, u.text AS a, v.text AS b
FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant')"""
_WA, _WB = (f"len(regexp_extract_all({c}, '[^\\s]+'))" for c in "ab")
_DIGITS = "regexp_extract_all(regexp_replace({}, '\\[[^\\]]{{0,40}}\\]', ' ', 'g'), '[0-9]{{2,}}')"


def pair_reason():
    wa, wb = text.word_count("a"), text.word_count("b")
    digits = lambda c: F.regexp_extract_all(text.strip_bracket_refs(c), F.lit("([0-9]{2,})"), F.lit(1))
    odd = F.size(F.array_except(digits("a"), digits("b"))) + F.size(F.array_except(digits("b"), digits("a")))
    return text.first_reason(
        [
            ("empty", (F.trim("a") == "") | (F.trim("b") == "")),
            ("too_long", (wa > 250) | (wb > 250)),
            ("length_ratio", (wa >= 4) & (wb >= 4) & (F.greatest(wa, wb) / F.least(wa, wb) > 2.5)),
            ("cyrillic", text.has_cyrillic("a")),
            ("mostly_symbols", text.mostly_symbols("a") | text.mostly_symbols("b")),
            ("untranslated", F.lower("a") == F.lower("b")),
            ("digits_disagree", (wa >= 4) & (odd > 0)),
        ]
    )


@query(rf"""WITH {_P}, r AS (SELECT *, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 'empty' WHEN {_WA} > 250 OR {_WB} > 250 THEN 'too_long'
WHEN {_WA} >= 4 AND {_WB} >= 4 AND greatest({_WA}, {_WB}) / least({_WA}, {_WB})::DOUBLE > 2.5 THEN 'length_ratio'
WHEN length(regexp_replace(a, '[^\p{{L}}]', '', 'g')) < 0.3 * length(a) OR length(regexp_replace(b, '[^\p{{L}}]', '', 'g')) < 0.3 * length(b) THEN 'mostly_symbols' WHEN lower(a) = lower(b) THEN 'untranslated'
WHEN {_WA} >= 4 AND (len(list_filter({_DIGITS.format("a")}, lambda x: NOT list_contains({_DIGITS.format("b")}, x))) > 0 OR len(list_filter({_DIGITS.format("b")}, lambda x: NOT list_contains({_DIGITS.format("a")}, x))) > 0) THEN 'digits_disagree' END AS reason FROM p),
d AS (SELECT lower(a) AS x, lower(b) AS y, min(id) AS first FROM r WHERE reason IS NULL GROUP BY 1, 2)
SELECT corpus, coalesce(reason, CASE WHEN id > first THEN 'duplicate' ELSE 'kept' END) AS reason, count(*) AS n FROM r LEFT JOIN d ON lower(a) = x AND lower(b) = y GROUP BY 1, 2""")
def pair_reasons(spark, sf):
    rows = pairs(spark, sf).withColumn("reason", pair_reason()).withColumns({"x": F.lower("a"), "y": F.lower("b")})
    first = rows.where("reason IS NULL").groupBy("x", "y").agg(F.min("id").alias("first"))
    done = rows.join(first, ["x", "y"], "left")
    return done.groupBy("corpus", F.coalesce("reason", F.when(F.col("id") > F.col("first"), "duplicate").otherwise("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT corpus, count(*) AS n, round(stddev_pop(ln(length(b) / length(a)::DOUBLE)), 6) AS sd, round(sum(length(b)) / sum(length(a)), 6) AS ratio FROM p WHERE length(a) > 0 AND length(b) > 0 GROUP BY 1")
def pair_length_shape(spark, sf):
    rows = pairs(spark, sf).where("length(a) > 0 AND length(b) > 0")
    return rows.groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.stddev_pop(F.ln(F.length("b") / F.length("a"))), 6).alias("sd"), F.round(F.sum(F.length("b")) / F.sum(F.length("a")), 6).alias("ratio"))


@query(f"WITH {_P} SELECT id FROM p WHERE length(a) >= 3 AND length(b) >= 3 AND ln(length(b) / length(a)::DOUBLE) BETWEEN -0.28 AND 0.40")
def length_band(spark, sf):
    ratio = F.ln(F.length("b") / F.length("a"))
    return pairs(spark, sf).where((F.length("a") >= 3) & (F.length("b") >= 3)).where(ratio.between(-0.28, 0.40)).select("id")


@query(f"""WITH {_P}, h AS (SELECT id, lower(trim(a)) AS a, lower(trim(b)) AS b FROM p WHERE id % 5 = 0), t AS (SELECT lower(trim(a)) AS a, lower(trim(b)) AS b FROM p WHERE id % 5 <> 0),
m AS (SELECT id, EXISTS (SELECT 1 FROM t WHERE t.a = h.a AND t.b = h.b AND t.a <> '' AND t.b <> '') AS pair, EXISTS (SELECT 1 FROM t WHERE t.a = h.a AND t.a <> '') AS x, EXISTS (SELECT 1 FROM t WHERE t.b = h.b AND t.b <> '') AS y FROM h)
SELECT count(*) AS n, count_if(pair) AS pair, count_if(x AND NOT pair) AS side_a, count_if(y AND NOT pair) AS side_b FROM m""")
def leak_strengths(spark, sf):
    rows = pairs(spark, sf).select("id", F.lower(F.trim("a")).alias("a"), F.lower(F.trim("b")).alias("b"))
    found = rel.leak_strengths(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0"))
    return found.agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("pair", "side_a", "side_b")))


@query(f"WITH {_P}, h AS (SELECT lower(a) AS k FROM p WHERE id % 5 = 0 UNION SELECT lower(b) FROM p WHERE id % 5 = 0) SELECT id FROM p WHERE id % 5 <> 0 AND lower(a) NOT IN (SELECT k FROM h) AND lower(b) NOT IN (SELECT k FROM h)")
def either_side_anti(spark, sf):
    """Either side may be held out: two anti joins, never one with OR."""
    rows = pairs(spark, sf).withColumns({"x": F.lower("a"), "y": F.lower("b")})
    held = rows.where("id % 5 = 0").select(F.explode(F.array("x", "y")).alias("k")).distinct()
    return rel.exclude(rel.exclude(rows.where("id % 5 <> 0"), "x", held, "k"), "y", held, "k").select("id")


@query("""WITH s AS (SELECT role, text, min(conv_id) AS c, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT u.text AS k, u.c AS user_conv, v.c AS assistant_conv FROM s u JOIN s v ON u.text = v.text AND u.role = 'user' AND v.role = 'assistant' AND u.n = 1 AND v.n = 1""")
def unique_key_join(spark, sf):
    side = lambda role: table(spark, sf, "conversations").where(F.col("role") == role).select(F.col("text").alias("k"), F.col("conv_id").alias(f"{role}_conv"))
    return rel.unique_key_join([side("user"), side("assistant")], "k")


_TOK = "regexp_extract_all(lower({}), '[a-z]+')"


def tokens(c):
    return F.regexp_extract_all(F.lower(text.col(c)), F.lit("([a-z]+)"), F.lit(1))


@query(f"""WITH t AS (SELECT lang, doc_id, unnest({_TOK.format('text')}) AS token FROM documents), n AS (SELECT lang, count(*) AS total FROM t GROUP BY 1),
g AS (SELECT lang, token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY 1, 2) SELECT lang, token, df, tf, round(1e6 * tf / total, 6) AS rate FROM g JOIN n USING (lang) WHERE df >= 3""")
def rate_per_million(spark, sf):
    rows = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"), tokens("text").alias("tokens"))
    return learning.document_frequency(rows, "lang").where("df >= 3").select("lang", "token", "df", "tf", F.round(stats.per_million("tf", "total"), 6).alias("rate"))


@query(f"""WITH t AS (SELECT unnest({_TOK.format('text')}) AS token, lang FROM documents), g AS (SELECT token, count_if(lang = 'en') AS nb, count_if(lang <> 'en') AS na FROM t GROUP BY 1)
SELECT token, nb, na, round(nb / (nb + na)::DOUBLE, 6) AS share FROM g WHERE nb >= 20 AND nb / (nb + na)::DOUBLE >= 0.98""")
def share_admission(spark, sf):
    flat = table(spark, sf, "documents").select("lang", F.explode(tokens("text")).alias("token"))
    g = flat.groupBy("token").agg(F.count_if(F.col("lang") == "en").alias("nb"), F.count_if(F.col("lang") != "en").alias("na"))
    return g.withColumn("share", F.col("nb") / (F.col("nb") + F.col("na"))).where("nb >= 20 AND share >= 0.98").withColumn("share", F.round("share", 6))


_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda x: length(x) > 3), lambda x: substr(x, 1, 6)))"
_T = f"t AS (SELECT id, {_STEMS.format('a')} AS x, {_STEMS.format('b')} AS y FROM p)"


def stemmed(spark, sf):
    short = lambda c: F.array_distinct(F.transform(F.filter(tokens(c), lambda x: F.length(x) > 3), lambda x: F.substring(x, 1, 6)))
    return pairs(spark, sf).select("id", short("a").alias("x"), short("b").alias("y"))


@query(f"WITH {_P}, {_T}, f AS (SELECT id, unnest(x) AS x, y FROM t) SELECT x, y, count(*) AS n FROM (SELECT x, unnest(y) AS y FROM f) GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccurrence_pairs(spark, sf):
    return learning.cooccurrence(stemmed(spark, sf), "x", "y", 2)


_ONLY = f"""{_P}, {_T}, o AS (SELECT list_filter(x, lambda v: NOT list_contains(y, v)) AS x, list_filter(y, lambda v: NOT list_contains(x, v)) AS y FROM t),
sx AS (SELECT x, count(*) AS seen_x FROM (SELECT unnest(x) AS x FROM o) GROUP BY 1), sy AS (SELECT y, count(*) AS seen_y FROM (SELECT unnest(y) AS y FROM o) GROUP BY 1),
c AS (SELECT x, y, count(*) AS n FROM (SELECT x, unnest(y) AS y FROM (SELECT unnest(x) AS x, y FROM o)) GROUP BY 1, 2)"""


@query(f"WITH {_ONLY} SELECT x, y, n, round(n / seen_x::DOUBLE, 6) AS assoc, round(2 * n / (seen_x + seen_y)::DOUBLE, 6) AS dice FROM c JOIN sx USING (x) JOIN sy USING (y) WHERE n >= 2")
def association_dice(spark, sf):
    """Words of one side only against words of the other side only."""
    only = stemmed(spark, sf).select(F.array_except("x", "y").alias("x"), F.array_except("y", "x").alias("y"))
    return learning.association(only.withColumnsRenamed({"x": "xs", "y": "ys"}), "xs", "ys").where("n >= 2").select("x", "y", "n", F.round("assoc", 6).alias("assoc"), F.round("dice", 6).alias("dice"))


@query(f"""WITH {_ONLY}, r AS (SELECT x, y, n, n / seen_x::DOUBLE AS p, (n / seen_x::DOUBLE) / (seen_y / (SELECT count(*) FROM o)::DOUBLE) AS lift FROM c JOIN sx USING (x) JOIN sy USING (y) WHERE seen_x >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY p DESC, y) AS r, max(p) OVER (PARTITION BY x) AS best FROM r WHERE p >= 0.25 AND lift >= 2)
SELECT x, y, round(p, 6) AS p, round(lift, 6) AS lift FROM k WHERE r <= 4 AND p >= 0.7 * best""")
def gloss_lift(spark, sf):
    only = stemmed(spark, sf).select(F.array_except("x", "y").alias("xs"), F.array_except("y", "x").alias("ys"))
    all_ = only.agg(F.count("*").alias("all"))
    r = learning.association(only, "xs", "ys").where("seen_x >= 3").join(F.broadcast(all_))
    r = r.select("x", "y", F.col("assoc").alias("p"), (F.col("assoc") / (F.col("seen_y") / F.col("all"))).alias("lift")).where("p >= 0.25 AND lift >= 2")
    k = r.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("p"), "y"))).withColumn("best", F.max("p").over(Window.partitionBy("x")))
    return k.where("r <= 4 AND p >= 0.7 * best").select("x", "y", F.round("p", 6).alias("p"), F.round("lift", 6).alias("lift"))


_GRAMS = "list_concat(list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1])), list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || {0}[i + 1] || {0}[i + 2]))"
_TEXT = "chars"
_CHARS = "(SELECT *, string_split(lower(text), '') AS chars FROM documents)"
_NB = f"""g AS (SELECT lang AS label, unnest({_GRAMS.format(_TEXT)}) AS gram FROM {_CHARS} WHERE doc_id % 5 <> 0),
m AS (SELECT label, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING length(gram) = 1 OR count(*) >= 3)"""


def _model(spark, sf):
    """A detector of the language, from four fifths of the rows; the last fifth is held out."""
    return learning.bayes_train(table(spark, sf, "documents").where("doc_id % 5 <> 0"), "lang", "text")


@query(f"WITH {_NB} SELECT label, count(*) AS grams, sum(n)::BIGINT AS total, max(n) AS most FROM m GROUP BY 1")
def nb_train(spark, sf):
    return _model(spark, sf).groupBy("label").agg(F.count("*").alias("grams"), F.sum("n").alias("total"), F.max("n").alias("most"))


_PRED = f"""{_NB}, t AS (SELECT label, sum(n) AS total FROM m GROUP BY 1), v AS (SELECT count(DISTINCT gram) AS v FROM m),
q AS (SELECT id, gram, count(*) AS c FROM (SELECT doc_id AS id, unnest({_GRAMS.format(_TEXT)}) AS gram FROM {_CHARS} WHERE doc_id % 5 = 0) GROUP BY 1, 2),
s AS (SELECT id, t.label, round(coalesce(sum(c * ln(n + 1.0)), 0) - any_value(len) * ln((any_value(total) + any_value(v))::DOUBLE), 6) AS score
  FROM (SELECT id, sum(c) AS len FROM q GROUP BY 1) JOIN t ON true JOIN v ON true LEFT JOIN (SELECT q.id AS qid, q.c, m.label AS ml, m.n FROM q JOIN m USING (gram)) ON qid = id AND ml = t.label GROUP BY 1, 2),
b AS (SELECT id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, (label = 'en') DESC) AS r FROM s) WHERE r = 1)"""


def _predicted(spark, sf):
    rows = table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), "text")
    return learning.bayes_predict(rows, _model(spark, sf), "text", "en")


@query(f"WITH {_PRED} SELECT id, predicted FROM b")
def nb_predict(spark, sf):
    return _predicted(spark, sf)


@query(f"WITH {_PRED} SELECT lang, count(*) AS n, count_if(predicted = lang) AS hits FROM b JOIN documents ON id = doc_id GROUP BY 1")
def nb_accuracy(spark, sf):
    truth = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return _predicted(spark, sf).join(truth, "id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("lang")).alias("hits"))


_EM = f"{_P}, t AS (SELECT id, {_STEMS.format('a')} AS x, {_STEMS.format('b')} AS y FROM p), f0 AS (SELECT id, y, unnest(x) AS x FROM (SELECT id, x, unnest(y) AS y FROM t)), k AS (SELECT x, y FROM f0 GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT f0.* FROM f0 JOIN k USING (x, y)), p0 AS (SELECT x, y, 1.0::DOUBLE AS p FROM k)"
for _i in (1, 2):
    _EM += f", w{_i} AS (SELECT id, x, y, p / sum(p) OVER (PARTITION BY id, y) AS e FROM f JOIN p{_i - 1} USING (x, y)), c{_i} AS (SELECT x, y, sum(e) AS c FROM w{_i} GROUP BY 1, 2), p{_i} AS (SELECT x, y, c / sum(c) OVER (PARTITION BY x) AS p FROM c{_i})"


@query(f"WITH {_EM} SELECT x, y, round(p, 6) AS p FROM p2 WHERE p >= 1e-4")
def model1_two_iterations(spark, sf):
    rows = stemmed(spark, sf).withColumnsRenamed({"x": "xs", "y": "ys"})
    return learning.translation_table(rows, "xs", "ys", 2).withColumn("p", F.round("p", 6))


_FOLD = "translate(w, 'áéíóúñüäöàèêç', 'aeiounuaoaeec')"


@query(rf"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}{{2,}}')) AS w FROM documents), g AS (SELECT {_FOLD} AS folded, w AS form, count(*) AS n FROM t GROUP BY 1, 2)
SELECT folded, count(*) AS forms, sum(n)::BIGINT AS total, max_by(form, n * 1000000 - length(form)) AS top, round(max(n) / sum(n), 6) AS share FROM g GROUP BY 1 HAVING sum(n) >= 5 AND max(n) / sum(n) >= 0.9 AND count(*) > 1""")
def restore_dominant(spark, sf):
    """Accented forms by folded spelling; the dominant form restores marks."""
    flat = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("form"))
    g = flat.groupBy("form").agg(F.count("*").alias("n")).withColumn("folded", F.translate("form", "áéíóúñüäöàèêç", "aeiounuaoaeec"))
    out = g.groupBy("folded").agg(F.count("*").alias("forms"), F.sum("n").alias("total"), F.max_by("form", F.col("n") * 1000000 - F.length("form")).alias("top"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.max("n").alias("m"))
    return out.where("total >= 5 AND m / total >= 0.9 AND forms > 1").drop("m")


_HIT = f"""{_P}, x AS (SELECT id, corpus, unnest({_TOK.format('a')}) AS w FROM p), y AS (SELECT id, unnest({_TOK.format('b')}) AS w FROM p), xc AS (SELECT id, corpus, w, count(*) AS n FROM x GROUP BY 1, 2, 3), yc AS (SELECT id, w, count(*) AS n FROM y GROUP BY 1, 2),
r AS (SELECT xc.id, corpus, sum(xc.n) AS need, sum(least(xc.n, coalesce(yc.n, 0))) AS hit FROM xc LEFT JOIN yc ON xc.id = yc.id AND xc.w = yc.w GROUP BY 1, 2), f AS (SELECT id, sum(n) AS found FROM yc GROUP BY 1)"""


def _hits(spark, sf):
    rows = pairs(spark, sf)
    x = rows.select("id", "corpus", F.explode(tokens("a")).alias("w")).groupBy("id", "corpus", "w").agg(F.count("*").alias("n"))
    y = rows.select("id", F.explode(tokens("b")).alias("w")).groupBy("id", "w").agg(F.count("*").alias("m"))
    hit = x.join(y, ["id", "w"], "left").groupBy("id", "corpus").agg(F.sum("n").alias("need"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hit"))
    return hit.join(y.groupBy("id").agg(F.sum("m").alias("found")), "id", "left")


@query(f"WITH {_HIT} SELECT corpus, round(sum(hit) / sum(need), 6) AS micro, round(avg(hit / need), 6) AS macro, sum(greatest(0, coalesce(found, 0) - hit))::BIGINT AS invented, count_if(need BETWEEN 1 AND 20) AS small, count_if(need > 20) AS large FROM r LEFT JOIN f USING (id) GROUP BY 1")
def recall_micro_macro(spark, sf):
    return _hits(spark, sf).groupBy("corpus").agg(F.round(F.sum("hit") / F.sum("need"), 6).alias("micro"), F.round(F.avg(F.col("hit") / F.col("need")), 6).alias("macro"), F.sum(F.greatest(F.lit(0), F.coalesce("found", F.lit(0)) - F.col("hit"))).alias("invented"), F.count_if(F.col("need").between(1, 20)).alias("small"), F.count_if(F.col("need") > 20).alias("large"))


@query(f"WITH {_HIT} SELECT CASE WHEN need <= 5 THEN '1-5' WHEN need <= 20 THEN '6-20' ELSE '21+' END AS size, count(*) AS n, round(sum(hit) / sum(need), 6) AS recall FROM r GROUP BY 1")
def size_class_recall(spark, sf):
    size = F.when(F.col("need") <= 5, "1-5").when(F.col("need") <= 20, "6-20").otherwise("21+")
    return _hits(spark, sf).groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.round(F.sum("hit") / F.sum("need"), 6).alias("recall"))


@query(f"WITH {_P}, x AS (SELECT id, unnest({_TOK.format('a')}) AS w FROM p), y AS (SELECT id, unnest({_TOK.format('b')}) AS w FROM p), xc AS (SELECT id, w, count(*) AS n FROM x GROUP BY 1, 2), yc AS (SELECT id, w, count(*) AS n FROM y GROUP BY 1, 2) SELECT sum(least(coalesce(xc.n, 0), coalesce(yc.n, 0)))::BIGINT AS agreed, sum(greatest(coalesce(xc.n, 0), coalesce(yc.n, 0)))::BIGINT AS either, sum(greatest(coalesce(xc.n, 0) - coalesce(yc.n, 0), 0))::BIGINT AS only_a FROM xc FULL JOIN yc ON xc.id = yc.id AND xc.w = yc.w")
def multiset_agreement(spark, sf):
    flat = lambda c: pairs(spark, sf).select("id", F.explode(tokens(c)).alias("w"))
    both = rel.multiset_counts(flat("a"), flat("b"), ["id", "w"])
    return both.agg(F.sum(F.least("n_left", "n_right")).alias("agreed"), F.sum(F.greatest("n_left", "n_right")).alias("either"), F.sum(F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))).alias("only_a"))


@query()
def wer_word_level(spark, sf):
    """Word error rate by corpus: 100 * edits / reference words; word distances have no SQL."""
    rows = pairs(spark, sf).select("corpus", text.score_tokens("a").alias("ref"), text.score_tokens("b").alias("hyp"))
    scored = rows.select("corpus", F.size("ref").alias("words"), text.word_edits("ref", "hyp").alias("edits"))
    return scored.groupBy("corpus").agg(F.sum("edits").alias("edits"), F.sum("words").alias("words")).withColumn("wer", F.round(100 * F.col("edits") / F.greatest("words", F.lit(1)), 6))


@query()
def bleu_stats(spark, sf):
    """Sufficient statistics of corpus BLEU of b against a."""
    return learning.ngram_matches(pairs(spark, sf).select("id", tokens("b").alias("hyp"), tokens("a").alias("ref")), "hyp", "ref")


@query("""SELECT p_partkey, levenshtein(p_name, p_type)::INT AS edits, CASE WHEN p_name = p_type THEN 'exact' WHEN levenshtein(p_name, p_type) <= 1 THEN 'near' WHEN levenshtein(p_name, p_type) <= greatest(2, length(p_type) // 3) AND length(p_name) / length(p_type)::DOUBLE BETWEEN 0.6 AND 1.4 THEN 'substitution' ELSE 'garbage' END AS kind FROM part""")
def char_edit_class(spark, sf):
    d, ratio = F.levenshtein("p_name", "p_type"), F.length("p_name") / F.length("p_type")
    kind = F.when(F.col("p_name") == F.col("p_type"), "exact").when(d <= 1, "near").when((d <= F.greatest(F.lit(2), F.floor(F.length("p_type") / 3))) & ratio.between(0.6, 1.4), "substitution").otherwise("garbage")
    return table(spark, sf, "part").select("p_partkey", d.alias("edits"), kind.alias("kind"))


@query("""WITH g AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, n, k, round((k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS lo,
round(least(1, (k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS hi FROM g""")
def label_rate_wilson(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    lo, hi = stats.wilson("k", "n")
    return g.select("source", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, count_if(quality IS NULL OR quality = 1) AS kept FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def label_join_keep_unknown(spark, sf):
    """A missing label abstains: such rows are kept."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull() | (F.col("quality") == 1)).alias("kept"))


@query(f"WITH {_P}, t AS (SELECT id, corpus, {_STEMS.format('a')} AS x, {_STEMS.format('b')} AS y FROM p) SELECT corpus, count_if(len(x) = 0) AS abstain, round(avg(len(list_intersect(x, y)) / nullif(len(x), 0)::DOUBLE), 6) AS rubric, round(avg(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0)::DOUBLE), 6) AS jaccard FROM t GROUP BY 1")
def overlap_rubric(spark, sf):
    rows = stemmed(spark, sf).join(pairs(spark, sf).select("id", "corpus"), "id")
    both = F.size(F.array_intersect("x", "y"))
    return rows.groupBy("corpus").agg(F.count_if(F.size("x") == 0).alias("abstain"), F.round(F.avg(both / F.nullif(F.size("x"), F.lit(0))), 6).alias("rubric"), F.round(F.avg(both / F.nullif(F.size("x") + F.size("y") - both, F.lit(0))), 6).alias("jaccard"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS shape, count(*) AS turns FROM conversations GROUP BY 1")
def rejoin_in_order(spark, sf):
    """Rows of a group put together again in their order."""
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("v")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]), " ").alias("shape"), F.count("*").alias("turns"))


@query(f"WITH {_P}, o AS (SELECT id, b, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM p) SELECT o.id, md5(s.b) AS control FROM o JOIN o s ON s.r = CASE WHEN o.r = o.n THEN 1 ELSE o.r + 1 END")
def shuffled_control(spark, sf):
    """Each row with the next row's other side, the last with the first's."""
    from .corpus import positions

    rows = positions(pairs(spark, sf).select("id", "b"), "id")
    total = rows.agg(F.count("*").alias("n"))
    moved = rows.join(F.broadcast(total)).select(((F.col("pos") - 1 + F.col("n")) % F.col("n")).alias("pos"), F.md5("b").alias("control"))
    return rows.select("id", "pos").join(moved, "pos").select("id", "control")
