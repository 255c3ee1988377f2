"""Queries over documents: normal forms, filters with named reasons, dedup, exclusion, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import relational as rel
from ..operators.tables import positions, written
from .registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def reasons(df):
    df = df.withColumn("words_", text.word_count("text"))
    n, low = F.col("words_"), F.lower("text")
    rules = [
        ("empty", F.coalesce(F.trim("text"), F.lit("")) == ""),
        ("too_short", n < 20),
        ("too_long", n > 2000),
        ("mostly_symbols", text.mostly_symbols("text")),
        ("url", low.rlike("https?://")),
    ]
    return df.withColumn("reason", text.first_reason(rules)).drop("words_")


def with_duplicates(df):
    """Duplicates are found among what no other rule has dropped; the first document number stays.

    Texts are read once: what goes on, and is written, is their reason and digest."""
    keyed = df.withColumn("key_", F.when(F.col("reason").isNull(), F.md5(F.lower("text")))).drop("text")
    keyed = written(keyed, "reasons")
    first = keyed.where("reason IS NULL").groupBy("key_").agg(F.min("doc_id").alias("first_"))
    keyed = keyed.join(first, "key_", "left")
    return keyed.withColumn("reason", F.coalesce("reason", F.when(F.col("doc_id") > F.col("first_"), "duplicate"))).drop("key_", "first_")


_WORDS = r"len(regexp_extract_all(text, '[^\s]+'))"
_REASONS = rf"""
r AS (SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN {_WORDS} < 20 THEN 'too_short' WHEN {_WORDS} > 2000 THEN 'too_long'
  WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < 0.3 * length(text) THEN 'mostly_symbols' WHEN regexp_matches(lower(text), 'https?://') THEN 'url' END AS reason FROM documents),
f AS (SELECT lower(text) AS k, min(doc_id) AS first FROM r WHERE reason IS NULL GROUP BY 1),
c AS (SELECT r.* EXCLUDE (reason), coalesce(reason, CASE WHEN doc_id > first THEN 'duplicate' END) AS reason FROM r LEFT JOIN f ON lower(r.text) = f.k)
"""


@query(f"WITH {_REASONS} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM c GROUP BY 1, 2")
def filter_report(spark, sf):
    done = with_duplicates(reasons(docs(spark, sf)))
    return done.groupBy("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {_REASONS} SELECT coalesce(source, 'ALL') AS source, coalesce(reason, 'ALL') AS reason, count(*) AS n FROM (SELECT source, coalesce(reason, 'kept') AS reason FROM c) GROUP BY ROLLUP (source, reason)")
def filter_accounting_rollup(spark, sf):
    done = with_duplicates(reasons(docs(spark, sf))).select("source", F.coalesce("reason", F.lit("kept")).alias("reason"))
    return done.rollup("source", "reason").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("reason", F.lit("ALL")).alias("reason"), "n")


@query(f"""WITH {_REASONS}, g AS (SELECT source, reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, reason) AS r FROM g)
SELECT source, string_agg(reason || ':' || n, ' ' ORDER BY r) AS top FROM w WHERE r <= 3 GROUP BY 1""")
def top_drop_reasons(spark, sf):
    g = with_duplicates(reasons(docs(spark, sf))).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n"))
    top = g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "reason"))).where("r <= 3")
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "reason", "n"))), lambda x: F.concat(x["reason"], F.lit(":"), x["n"].cast("string"))), " ").alias("top"))


@query(r"""SELECT CASE WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'cyrillic' WHEN regexp_matches(text, '[^\x00-\x7f]') THEN 'marked' ELSE 'plain' END AS script, count(*) AS n,
count_if(length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 0.3 * length(text)) AS symbols FROM documents GROUP BY 1""")
def script_class(spark, sf):
    kind = F.when(text.has_cyrillic("text"), "cyrillic").when(F.col("text").rlike(r"[^\x00-\x7f]"), "marked").otherwise("plain")
    return docs(spark, sf).groupBy(kind.alias("script")).agg(F.count("*").alias("n"), F.count_if(text.mostly_symbols("text")).alias("symbols"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS uppers FROM documents
WHERE length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 8 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE >= 0.8""")
def upper_shouted(spark, sf):
    return docs(spark, sf).where(text.shouted("text")).select("doc_id", text.letter_count("text").cast("long").alias("letters"), text.upper_count("text").cast("long").alias("uppers"))


@query()
def pathological_source(spark, sf):
    """Back references are not SQL; tests hold the cases."""
    return docs(spark, sf).select("doc_id", source_rejection("text").alias("reason"))


def source_rejection(c):
    """Why a line is no Latin-script source text; null if it is."""
    c = text.col(c)
    letters = text.letter_count(F.regexp_replace(c, r"[^\p{IsLatin}]", ""))
    return text.first_reason(
        [
            ("long token/number", c.rlike(r"\S{81,}|\p{Nd}{19,}")),
            ("repeated alphanumeric", c.rlike(r"(?iu)([\p{L}\p{N}])\1{2,}")),
            ("non-Latin script", c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")),
            ("no Latin text", letters < 3),
        ]
    )



def _form(name: str, spark_form, sql_form: str):
    """A query that compares a normal form of every whole text by its digest."""

    def run(spark, sf):
        return docs(spark, sf).select("doc_id", F.md5(spark_form("text")).alias("form"))

    run.__name__ = name
    run.__doc__ = f"Digest of each text's form {name}."
    query(f"SELECT doc_id, md5({sql_form}) AS form FROM documents" if sql_form else None)(run)
    return run


_SQ = r"trim(regexp_replace({}, '[\s\x{{A0}}]+', ' ', 'g'))"
_form("squeezed", text.normalized, _SQ.format("nfc_normalize(text)"))
_form("norm_key_exact", lambda c: text.squeeze(F.regexp_replace(F.lower(text.col(c)), r"\[\p{Nd}+\]", "")), _SQ.format(r"regexp_replace(lower(text), '\[[0-9]+\]', '', 'g')"))
_form("norm_key_letters_only", text.letters_only_key, r"array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ')")
_form("citations_stripped", text.strip_citations, _SQ.format(r"regexp_replace(text, '\[[0-9]+\]', '', 'g')"))
_form("bracket_refs_stripped", text.strip_bracket_refs, r"regexp_replace(text, '\[[^\]]{0,40}\]', ' ', 'g')")
_form("flattened", text.flatten, _SQ.format("coalesce(text, '')"))
_form("five_letter_folded", text.five_letter_fold, "translate(text, 'čćđšžČĆĐŠŽ', 'ccdszccdsz')")
_form("speech_keyed", text.speech_key, _SQ.format(r"regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_\s\x{A0}]', ' ', 'g')"))
_form("yat_folded", text.yat_fold, "regexp_replace(" + _SQ.format(r"regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_\s\x{A0}]', ' ', 'g')") + ", 'ije|je', 'e', 'g')")
_form("transcript_keyed", text.transcript_key, "nfc_normalize(lower(text))")
_form("to_cyrillic", text.to_cyrillic, "translate(" + "replace(" * 9 + "text" + "".join(f", '{a}', '{b}')" for a, b in [(latin, c) for c, latin in text.DIGRAPHS] + text.TITLED) + f", '{text.LATIN}', '{text.CYRILLIC}')")
_form("round_trip_script", lambda c: text.to_latin(text.to_cyrillic(c)), "")
_form("near_keyed", text.near_key, "")
_form("leak_keyed", text.leak_key, "")
_form("marks_folded", lambda c: text.fold_marks(text.col(c)), "")
_form("forward_input", text.forward_input, "")
_form("sentence_cased", lambda c: text.sentence_case(text.col(c)), "")


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+'))::BIGINT AS words, len(regexp_extract_all(text, '[a-zA-ZčćžšđČĆŽŠĐ]+'))::BIGINT AS plain,
md5(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+'), lambda x: length(x) > 1), lambda x: substr(x, 1, 6)), ' ')) AS stems FROM documents""")
def token_forms(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.word_tokens("text")).cast("long").alias("words"), F.size(text.alphabet_tokens("text")).cast("long").alias("plain"), F.md5(F.array_join(text.stems("text"), " ")).alias("stems"))


@query()
def sentence_counts(spark, sf):
    """Curated, served and naive splitters side by side; look-behind is not in the check's dialect."""
    return docs(spark, sf).select("doc_id", F.size(text.split_sentences("text")).alias("curated"), F.size(text.served_sentences("text")).alias("served"), F.size(text.naive_sentences("text")).alias("naive"))


@query("SELECT doc_id, i - 1 AS pos, trim(l) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''")
def lines_to_rows(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("line").alias("line")).where("line <> ''")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1 GROUP BY 1")
def dedup_exact_keep_first(spark, sf):
    kept = rel.keep_first(docs(spark, sf).select("doc_id", "source", "n_chars", F.md5(F.lower("text")).alias("key")), "key", "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def dedup_cap_per_source(spark, sf):
    return rel.cap_per_group(docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 10)


_RANK = "regexp_extract(source, '[0-9]+')::INT"


@query(f"SELECT source, count(*) AS n FROM (SELECT source, {_RANK} AS k, min({_RANK}) OVER (PARTITION BY lower(text)) AS m FROM documents) WHERE k = m GROUP BY 1")
def cross_source_suppress(spark, sf):
    rows = docs(spark, sf).select("source", F.md5(F.lower("text")).alias("t"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("k"))
    return rel.suppress_across_sources(rows, F.col("t"), "k").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT md5(lower(text)) AS key, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def cross_shard_duplicates(spark, sf):
    keyed = docs(spark, sf).select(F.md5(F.lower("text")).alias("key"), "source")
    return keyed.groupBy("key", "source").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("sources")).where("n > 1")


@query("SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def decontam_contains(spark, sf):
    """A text can only hold a passage if it holds the passage's second and third word in a row: texts and
    passages meet on such pairs first. Passages too short for that, a bounded list, are compared with all."""
    held = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    keys = held.select("item_id", "passage", F.slice(text.words("passage"), 2, 2).alias("k"))
    pairs = lambda c: F.expr(f"transform(sequence(1, greatest(size({c}) - 1, 1)), i -> slice({c}, i, 2))")
    flat = docs(spark, sf).select("doc_id", "text", text.words("text").alias("w")).select("doc_id", "text", F.explode(F.array_distinct(pairs("w"))).alias("k"))
    short = held.where(F.size(text.words("passage")) < 4)
    long = keys.where(F.size(text.words("passage")) >= 4)
    met = flat.join(long, "k").where(F.contains("text", "passage")).select("doc_id", "item_id")
    rest = docs(spark, sf).join(F.broadcast(short), F.contains("text", "passage")).select("doc_id", "item_id")
    return met.unionByName(rest).distinct()


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(trim(b.text)) = lower(trim(d.text)))")
def decontam_anti(spark, sf):
    return rel.exclude(docs(spark, sf), F.lower(F.trim("text")), table(spark, sf, "benchmark"), F.lower(F.trim("text"))).select("doc_id", "source")


_SETS = r"list_distinct(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) > 3))"


def word_sets(df, key):
    return df.select(F.col(key).alias("id"), F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)), lambda x: F.length(x) > 3)).alias("words"))


@query(rf"""WITH s AS (SELECT min(doc_id) AS id, w FROM (SELECT doc_id, list_sort({_SETS}) AS w FROM documents) WHERE len(w) > 0 GROUP BY w)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.id < b.id AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w)
WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def near_dup_jaccard(spark, sf):
    return rel.jaccard_join(word_sets(docs(spark, sf), "doc_id"), 0.8).withColumn("jaccard", F.round("jaccard", 6))


_CANDIDATES = rf"""
t AS (SELECT doc_id AS id, {_SETS} AS w FROM documents), h AS (SELECT item_id AS id, {_SETS} AS w FROM benchmark),
tf AS (SELECT id, unnest(w) AS token FROM t), hf AS (SELECT id, unnest(w) AS token FROM h), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) <= 4000),
tr AS (SELECT id, token FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS r FROM tf JOIN df USING (token)) WHERE r <= 4),
hr AS (SELECT id, token FROM (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY df, token) AS r FROM hf JOIN df USING (token)) WHERE r <= 8),
m AS (SELECT hr.id AS held_id, tr.id AS train_id, count(*) AS shared FROM hr JOIN tr USING (token) GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held_id ORDER BY shared DESC, train_id) AS r FROM m) WHERE r <= 400),
j AS (SELECT held_id, train_id, len(list_intersect(h.w, t.w)) / (len(h.w) + len(t.w) - len(list_intersect(h.w, t.w)))::DOUBLE AS jaccard FROM k JOIN h ON h.id = held_id JOIN t ON t.id = train_id),
b AS (SELECT held_id, train_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY held_id ORDER BY jaccard DESC, train_id) AS r FROM j) WHERE r = 1)
"""


def _nearest(spark, sf):
    return rel.candidate_pairs(word_sets(docs(spark, sf), "doc_id"), word_sets(table(spark, sf, "benchmark"), "item_id"))


@query(f"WITH {_CANDIDATES} SELECT held_id, train_id, round(jaccard, 6) AS jaccard FROM b")
def rare_token_candidates(spark, sf):
    return _nearest(spark, sf).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_CANDIDATES} SELECT count_if(jaccard >= 0.9) AS at_90, count_if(jaccard >= 0.7) AS at_70, count_if(jaccard >= 0.5) AS at_50, count(*) AS n FROM b")
def jaccard_histogram(spark, sf):
    return _nearest(spark, sf).agg(*(F.count_if(F.col("jaccard") >= x / 100).alias(f"at_{x}") for x in (90, 70, 50)), F.count("*").alias("n"))


_SHARE = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT CASE WHEN {_SHARE.format('lower(trim(text))')} < 0.1 THEN 'valid' ELSE 'train' END AS split, count(*) AS n, min(doc_id) AS first, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def hash_split(spark, sf):
    split = F.when(stats.hash_share(F.lower(F.trim("text"))) < 0.1, "valid").otherwise("train")
    return docs(spark, sf).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.sum("doc_id").alias("ids"))


@query("SELECT ('0x' || substr(md5(source), 1, 8))::BIGINT % 10 AS bucket, source, count(*) AS n FROM documents GROUP BY 1, 2")
def source_bucket_split(spark, sf):
    bucket = F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long") % 10
    return docs(spark, sf).groupBy(bucket.alias("bucket"), "source").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT lower(trim(text)) AS k, CASE WHEN {_SHARE.format('lower(trim(text))')} < 0.1 THEN 'valid' ELSE 'train' END AS split FROM documents)
SELECT 'no_shared_key' AS name, count(*) = 0 AS ok, count(*)::VARCHAR AS detail FROM (SELECT k FROM s WHERE split = 'valid' INTERSECT SELECT k FROM s WHERE split = 'train')""")
def split_disjoint_check(spark, sf):
    from ..operators import checks

    key = F.lower(F.trim("text"))
    rows = docs(spark, sf).select(F.md5(key).alias("k"), (stats.hash_share(key) < 0.1).alias("valid"))
    return checks.disjoint(rows.where("valid"), rows.where("NOT valid"), "k", "no_shared_key")


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def hash_sample(spark, sf):
    return docs(spark, sf).select("doc_id", "source").orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id").limit(50)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r BETWEEN 51 AND 80")
def extension_sample(spark, sf):
    """Rows 51 to 80 of the frozen order: two bounded top-k's and their difference, without ranking all rows."""
    order = [F.md5(F.concat(F.lit("7:"), "doc_id")), F.col("doc_id")]
    ids = docs(spark, sf).select("doc_id")
    return ids.orderBy(*order).limit(80).join(ids.orderBy(*order).limit(50), "doc_id", "left_anti")


@query("SELECT (SELECT count(*) FROM documents) AS population, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 7)")
def reservoir_count(spark, sf):
    rows = docs(spark, sf)
    sample = rows.orderBy(F.md5(F.concat(F.lit("11:"), "doc_id")), "doc_id").limit(7).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return rows.agg(F.count("*").alias("population")).join(F.broadcast(sample))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents),
s AS (SELECT doc_id, pos, CASE WHEN pos < (total % 3) * (total // 3 + 1) THEN pos // (total // 3 + 1) ELSE (total % 3) + (pos - (total % 3) * (total // 3 + 1)) // (total // 3) END AS shard FROM p)
SELECT shard::BIGINT AS shard, count(*) AS size, min(pos) AS lo, max(pos) AS hi, sum(doc_id)::BIGINT AS ids FROM s GROUP BY 1""")
def shard_bounds(spark, sf):
    total = docs(spark, sf).agg(F.count("*").alias("total"))
    placed = positions(docs(spark, sf).select("doc_id"), "doc_id").join(F.broadcast(total))
    return placed.groupBy(rel.balanced_bounds(F.col("pos"), F.col("total"), 3).alias("shard")).agg(F.count("*").alias("size"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("doc_id").alias("ids"))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents),
s AS (SELECT *, CASE WHEN pos < (total % 3) * (total // 3 + 1) THEN pos // (total // 3 + 1) ELSE (total % 3) + (pos - (total % 3) * (total // 3 + 1)) // (total // 3) END AS shard FROM p),
z AS (SELECT shard, count(*) AS n, any_value(total) // 3 + CASE WHEN shard < any_value(total) % 3 THEN 1 ELSE 0 END AS want FROM s GROUP BY 1),
f AS (SELECT 'sizes' AS name, count(*) FILTER (WHERE n <> want) AS bad FROM z
 UNION ALL SELECT 'moved', count(*) FILTER (WHERE u.doc_id <> p.doc_id) FROM (SELECT doc_id, row_number() OVER (ORDER BY shard, pos) - 1 AS pos FROM s) u JOIN p USING (pos)
 UNION ALL SELECT 'missing', (SELECT count(*) FROM documents) - (SELECT sum(n) FROM z)
 UNION ALL SELECT 'duplicate_sources', count(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(*) > 1))
SELECT name, bad = 0 AS ok, CAST(CAST(bad AS BIGINT) AS VARCHAR) AS detail FROM f""")
def shard_union_check(spark, sf):
    from ..operators import checks

    total = docs(spark, sf).agg(F.count("*").alias("total"))
    whole = positions(docs(spark, sf).select("doc_id"), "doc_id")
    shards = whole.join(F.broadcast(total)).withColumn("shard", rel.balanced_bounds(F.col("pos"), F.col("total"), 3))
    bounds = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("shard"), "total").select("shard", (F.floor(F.col("total") / 3) + F.when(F.col("shard") < F.col("total") % 3, 1).otherwise(0)).alias("size")).where("size > 0")
    return checks.shard_union(shards.select("shard", "pos", "doc_id"), whole, "doc_id", bounds)


@query("SELECT quality, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, quality, unnest(range(0, CASE WHEN quality = 1 THEN 3 ELSE 1 END)) AS copy FROM labels) GROUP BY 1")
def oversample_weights(spark, sf):
    copies = F.when(F.col("quality") == 1, 3).otherwise(1)
    return table(spark, sf, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(1), copies))).groupBy("quality").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("WITH c AS (SELECT count_if(quality = 0) AS b, count_if(quality = 1) AS x FROM labels) SELECT b AS base, x AS extra, greatest(1, round_even(0.5 * x / ((1 - 0.5) * b), 0))::BIGINT AS copies FROM c")
def share_mix(spark, sf):
    sums = table(spark, sf, "labels").agg(F.count_if(F.col("quality") == 0).alias("base"), F.count_if(F.col("quality") == 1).alias("extra"))
    return sums.withColumn("copies", F.greatest(F.lit(1), F.bround(0.5 * F.col("extra") / (0.5 * F.col("base")), 0)).cast("long"))


@query("""WITH c AS (SELECT count(*) AS n, count_if(toxic = 1) AS d FROM labels), x AS (SELECT greatest(0, round_even((0.3 * n - d) / (1 - 0.3), 0))::BIGINT AS x, d FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels WHERE toxic = 1)
SELECT r.doc_id, count(*) AS copies FROM x, r, (SELECT unnest(range(0, 100000)) AS k) WHERE k < x AND k % d = i GROUP BY 1""")
def rate_duplication(spark, sf):
    """Marked rows are repeated in turn until they are 30 % of all."""
    rows = table(spark, sf, "labels")
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("d")).withColumn("x", F.greatest(F.lit(0), F.bround((0.3 * F.col("n") - F.col("d")) / 0.7, 0)).cast("long"))
    marked = positions(rows.where("toxic = 1").select("doc_id"), "doc_id").join(F.broadcast(sums))
    copies = F.floor(F.col("x") / F.col("d")) + F.when(F.col("pos") < F.col("x") % F.col("d"), 1).otherwise(0)
    return marked.select("doc_id", copies.cast("long").alias("copies")).where("copies > 0")


@query("""WITH r AS (SELECT doc_id, source, lower(text) AS k, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS r FROM documents WHERE source = 'src1'), h AS (SELECT k FROM r WHERE r <= 10)
SELECT count(*) AS train, sum(doc_id)::BIGINT AS ids FROM documents WHERE lower(text) NOT IN (SELECT k FROM h)""")
def holdout_siblings(spark, sf):
    """Rows held out take all rows with the same text along."""
    rows = docs(spark, sf).withColumn("k", F.md5(F.lower("text")))
    held = rows.where("source = 'src1'").orderBy(F.md5(F.concat(F.lit("3:"), "doc_id")), "doc_id").limit(10)
    return rel.exclude(rows.select("doc_id", "k"), "k", held, "k").agg(F.count("*").alias("train"), F.sum("doc_id").alias("ids"))


@query("SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN r <= 50 THEN 'test' WHEN r <= 100 THEN 'valid' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('41:' || doc_id), doc_id) AS r FROM documents)) GROUP BY 1")
def fixed_size_split(spark, sf):
    order = [F.md5(F.concat(F.lit("41:"), "doc_id")), F.col("doc_id")]
    ids = docs(spark, sf).select("doc_id")
    test, both = ids.orderBy(*order).limit(50).withColumn("a", F.lit(1)), ids.orderBy(*order).limit(100).withColumn("b", F.lit(1))
    placed = ids.join(F.broadcast(test), "doc_id", "left").join(F.broadcast(both), "doc_id", "left")
    return placed.groupBy(F.when(F.col("a") == 1, "test").when(F.col("b") == 1, "valid").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT reason, doc_id FROM (SELECT reason, doc_id, row_number() OVER (PARTITION BY reason ORDER BY md5('r' || doc_id), doc_id) AS r FROM (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS reason FROM documents)) WHERE r <= 5""")
def stratified_review(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long").alias("reason"))
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(F.md5(F.concat(F.lit("r"), "doc_id")), "doc_id"))
    return rows.withColumn("r", rank).where("r <= 5").select("reason", "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i % greatest(1, n // 100) = 0")
def systematic_sample(spark, sf):
    total = docs(spark, sf).agg(F.count("*").alias("n"))
    return positions(docs(spark, sf).select("doc_id"), "doc_id").join(F.broadcast(total)).where(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("n") / 100)) == 0).select("doc_id")


@query("""WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT p, max(n_chars) FILTER (WHERE i = round_even((n - 1) * p, 0)) AS half_even, max(n_chars) FILTER (WHERE i = least(n - 1, floor(n * p))) AS floored FROM o, (VALUES (0.01::DOUBLE), (0.25), (0.5), (0.95)) v(p) GROUP BY 1""")
def quantile_two_rules(spark, sf):
    rows = positions(docs(spark, sf).select("doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("o")), "o")
    n, p = F.col("n"), F.col("p")
    ranks = docs(spark, sf).agg(F.count("*").alias("n")).select("n", F.explode(F.array(*(F.lit(x) for x in (0.01, 0.25, 0.5, 0.95)))).alias("p"))
    ranks = ranks.select("p", F.bround((n - 1) * p, 0).cast("long").alias("a"), F.least(n - 1, F.floor(n * p)).alias("b"))
    met = rows.join(F.broadcast(ranks), (F.col("pos") == F.col("a")) | (F.col("pos") == F.col("b")))
    return met.groupBy("p").agg(F.max(F.when(F.col("pos") == F.col("a"), F.col("n_chars"))).alias("half_even"), F.max(F.when(F.col("pos") == F.col("b"), F.col("n_chars"))).alias("floored"))


@query("SELECT lang, median(n_chars) AS med, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1")
def order_stats(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.median("n_chars").alias("med"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("sd"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("SELECT doc_id // 500 AS block, sha256(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY 1")
def ordered_content_hash(spark, sf):
    """Order-sensitive digests of blocks of 500 numbers; equal lists of digests mean equal tables."""
    rows = docs(spark, sf).select(F.floor(F.col("doc_id") / 500).alias("block"), F.struct("doc_id", F.md5("text").alias("m")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["m"])), "\n")
    return rows.groupBy("block").agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("n"))


@query("SELECT source, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, source) AS rank FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def source_shares(spark, sf):
    g = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long").alias("rank"))


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT n, row_number() OVER (ORDER BY n DESC, source) AS r FROM g)
SELECT round(sum(n) FILTER (WHERE r <= 5) / sum(n), 6) AS top5, median(n) AS med, count_if(n = 1) AS singles FROM t""")
def source_concentration(spark, sf):
    g = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    top = g.orderBy(F.desc("n"), "source").limit(5).agg(F.sum("n").alias("t"))
    return g.agg(F.sum("n").alias("s"), F.median("n").alias("med"), F.count_if(F.col("n") == 1).alias("singles")).join(F.broadcast(top)).select(F.round(F.col("t") / F.col("s"), 6).alias("top5"), "med", "singles")
