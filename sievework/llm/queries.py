"""Queries of the training-text operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, linededup, packing, quality, sharding, shared, simhash, tokenout, warc
from .shared import table

#: Bytes a shard, so that small tables split too.
OP5_LIMIT = 1 << 20


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    folder = shared.fresh_path(spark, "warc")
    manifest, shards = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, shards, folder, payload=False).drop("url", "payload")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = langid.train(docs, usable=~held)
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), limit=OP5_LIMIT, also=("source", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    folder = shared.fresh_path(spark, "tokens")
    manifest, shards = tokenout.write(table(spark, sf_dir, "documents"), folder)
    return tokenout.read(manifest, shards, folder)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.ready(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_quality, op3_langid, op4_line_dedup, op5_sharding, op6_simhash, op7_decontam, op8_packing, op9_token_ids, op10_licenses)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EDGE = r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""


def _op2() -> str:
    grams = sorted({quality.BASE_GRAM, *quality.MAX_COVERAGE})
    parts, joins, ok = [], [], []
    for n in grams:
        parts.append(f"""
a{n} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)),
b{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM a{n}),
c{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j FROM b{n} WHERE c > 1),
d{n} AS (SELECT c{n}.doc_id, count(*) AS words, sum(length(w.ws[j])) AS chars FROM c{n} JOIN w USING (doc_id) GROUP BY 1)""")
        joins.append(f"LEFT JOIN d{n} USING (doc_id)")
        if n in quality.MAX_COVERAGE:
            ok.append(f"coalesce(d{n}.chars, 0) / size <= {quality.MAX_COVERAGE[n]}")
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
l AS (SELECT doc_id, line, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}') GROUP BY 1, 2),
s AS (SELECT doc_id, sum(again)::BIGINT AS n_dup_lines, sum(again * length(line)) AS line_chars FROM l GROUP BY 1),
{",".join(parts)},
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(d{quality.BASE_GRAM}.words, 0)::BIGINT AS n_repeat_words,
             (n_words < {quality.MIN_WORDS} OR 100 * coalesce(d{quality.BASE_GRAM}.words, 0) > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
             ({" AND ".join(ok)} AND coalesce(line_chars, 0) / size <= {quality.MAX_LINE_COVERAGE} AND n_symbols <= {quality.MAX_SYMBOLS} * n_words) AS ok
      FROM (SELECT *, greatest(word_chars, 1)::DOUBLE AS size FROM m) LEFT JOIN s USING (doc_id) {" ".join(joins)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ok) AS kept FROM x
"""


_OP4 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, {_LOWER.format(_EDGE.format("line"))} AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, (h.first IS NOT NULL AND h.first < doc_id) AS lost FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP5 = f"""
WITH t AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, strlen(coalesce(text, ''))::BIGINT AS b FROM documents),
u AS (SELECT *, unnest(range(0, 40)) AS d FROM t),
s AS (SELECT d, h // (1::BIGINT << (60 - d)) AS p, sum(b) AS bytes, count(*) AS n FROM u GROUP BY 1, 2),
f AS (SELECT u.doc_id, u.h, u.b, min(u.d) AS depth FROM u JOIN s ON s.d = u.d AND s.p = u.h // (1::BIGINT << (60 - u.d)) WHERE bytes <= {OP5_LIMIT} OR n = 1 GROUP BY 1, 2, 3)
SELECT doc_id, b AS doc_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h // (1::BIGINT << (60 - depth))), depth::INT, '0') END AS shard,
       depth::INT AS depth, bytes::BIGINT AS shard_bytes, n::BIGINT AS shard_docs
FROM f JOIN s ON s.d = depth AND s.p = h // (1::BIGINT << (60 - depth))
"""

_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP7 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
c AS (SELECT item, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM c)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
a AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, (len(ws) - n + 2)::BIGINT)) AS i FROM d, (SELECT DISTINCT n FROM c))),
h AS (SELECT doc_id, i, a.n, item FROM a JOIN v ON a.win = v.win AND a.n = v.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """op3, op6, op8, op9 and op10 have none: learnt weights, XXH64, token ids and template scores are no SQL."""
    return {"op1_warc": _OP1, "op2_quality": _op2(), "op4_line_dedup": _OP4, "op5_sharding": _OP5, "op7_decontam": _OP7}
