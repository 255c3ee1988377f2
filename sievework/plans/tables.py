"""Queries over vectors, pages, events and the star tables: scores, windows, budgets, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import relational as rel
from .registry import query, table


def unit(spark, sf):
    """(vec_id, label, dim, x): coordinates of unit vectors."""
    e = table(spark, sf, "embeddings").withColumn("size", F.sqrt(stats.dot("embedding", "embedding")))
    flat = e.select("vec_id", "label", "size", F.posexplode("embedding").alias("dim", "x"))
    return flat.select("vec_id", "label", "dim", (F.col("x").cast("double") / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))).alias("x"))


_U = "u AS (SELECT vec_id, label, i AS dim, (embedding[i])::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


@query(f"WITH {_U}, c AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY 1) SELECT vec_id, round(sum(x * m) / any_value(size), 6) AS cosine FROM u JOIN c USING (label, dim) JOIN z USING (label) GROUP BY 1")
def cosine_to_centroid(spark, sf):
    return centroid_cosines(spark, sf).withColumn("cosine", F.round("cosine", 6))


def centroid_cosines(spark, sf):
    u = unit(spark, sf)
    c = u.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    size = c.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return u.join(c, ["label", "dim"]).join(size, "label").groupBy("vec_id").agg((F.sum(F.col("x") * F.col("m")) / F.first("size")).alias("cosine"))


@query(f"WITH {_U}, s AS (SELECT label, dim, sum(x) AS s FROM u GROUP BY 1, 2), n AS (SELECT label, count(DISTINCT vec_id) AS n FROM u GROUP BY 1) SELECT label, any_value(n) AS n, round(CASE WHEN any_value(n) = 1 THEN 1 ELSE (sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)) END, 6) AS cohesion FROM s JOIN n USING (label) GROUP BY 1")
def label_cohesion(spark, sf):
    """Mean cosine of all pairs of a group from the length of its sum: no pairs are made."""
    u = unit(spark, sf)
    s = u.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    n = F.first("n")
    return s.groupBy("label").agg(F.first("n").alias("n"), F.round(F.when(n == 1, 1.0).otherwise((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))), 6).alias("cohesion"))


@query(f"WITH {_U}, s AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 6) AS similarity FROM s a JOIN s b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2")
def cross_label_similarity(spark, sf):
    """Mean cosine between two groups is the product of their mean vectors; groups are few, vectors many."""
    s = unit(spark, sf).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    a, b = s.select(F.col("label").alias("a"), "dim", F.col("m").alias("x")), s.select(F.col("label").alias("b"), "dim", F.col("m").alias("y"))
    return a.join(b, "dim").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("similarity"))


@query(f"WITH {_U}, c AS (SELECT label, dim, avg(x) AS m FROM u GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY 1), k AS (SELECT vec_id, label, sum(x * m) / any_value(size) AS c FROM u JOIN c USING (label, dim) JOIN z USING (label) GROUP BY 1, 2) SELECT label, count(*) AS n, count_if(c < 0.6) AS dropped, round(median(c), 6) AS med FROM k GROUP BY 1")
def centroid_outliers(spark, sf):
    near = centroid_cosines(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return near.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("cosine") < 0.6).alias("dropped"), F.round(F.median("cosine"), 6).alias("med"))


@query("SELECT label, count(*) AS n, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM embeddings GROUP BY 1")
def collision_pairs(spark, sf):
    """Pairs of a group are counted, not made."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), (F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS form, length(html)::BIGINT AS n FROM pages")
def pages_stripped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.squeeze(F.regexp_replace("html", "<[^>]+>", " "))).alias("form"), F.length("html").cast("long").alias("n"))


@query()
def pages_text(spark, sf):
    """Entities need a table that SQL does not have."""
    return table(spark, sf, "pages").select("page_id", text.plain_html("html").alias("text"))


@query(r"SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, count(*) AS n, count_if(contains(url, '?')) AS queries FROM pages GROUP BY 1")
def pages_host_counts(spark, sf):
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.contains("url", F.lit("?"))).alias("queries"))


@query(r"""SELECT page_id, len(l)::BIGINT AS links, md5(array_to_string(l, ' ')) AS digest FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def link_extract(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.md5(F.array_join(links, " ")).alias("digest"))


@query(r"SELECT page_id, name || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS name FROM (SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS name, row_number() OVER (PARTITION BY regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') ORDER BY page_id) AS r FROM pages)")
def safe_names(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", text.safe_name("url").alias("base"))
    r = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    return rows.withColumn("r", r).select("page_id", F.concat("base", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("name"))


_RUN = "r AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)"


@query(f"WITH {_RUN} SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT *, max(CASE WHEN s > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS over FROM r) WHERE over = 0 GROUP BY 1")
def budget_prefix(spark, sf):
    """Rows in order until the next would exceed the budget, without skipping."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").withColumn("s", F.sum("value").over(w))
    rows = rows.withColumn("over", F.max((F.col("s") > 500).cast("int")).over(w)).where("over = 0")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query(f"WITH {_RUN} SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM r WHERE s - value < 500 GROUP BY 1")
def budget_exclusive(spark, sf):
    """Stops after the budget has been reached: the sum before each row decides."""
    rows = table(spark, sf, "events").withColumn("s", F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id")))
    return rows.where(F.col("s") - F.col("value") < 500).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT user_id, event_type, event_id, n > 1 AS clash FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE r = 1")
def last_writer_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count("*") > 1).alias("clash"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day::VARCHAR AS day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta,
CASE WHEN lag(n) OVER (PARTITION BY event_type ORDER BY day) IS NULL THEN 'waiting' WHEN n < lag(n) OVER (PARTITION BY event_type ORDER BY day) THEN 'slower' ELSE 'running' END AS state FROM d""")
def snapshot_delta(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    state = F.when(before.isNull(), "waiting").when(F.col("n") < before, "slower").otherwise("running")
    return d.select("event_type", F.col("day").cast("string").alias("day"), "n", (F.col("n") - before).alias("delta"), state.alias("state"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def sliding(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def session(spark, sf):
    s = table(spark, sf, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_type, count(*) AS n, count_if(json_valid(props)) AS valid FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos, event_type <> 'click' AS ok FROM events), c AS (SELECT *, sum(ok::INT) OVER (ORDER BY pos) AS acc FROM o),
m AS (SELECT min(pos) AS checked FROM c WHERE acc = 500) SELECT checked, 500::BIGINT AS accepted, checked - 500 AS rejected FROM m""")
def vocab_gate(spark, sf):
    """Candidates in order until 500 are accepted: the 500th accepted row ends the scan, found by a top-k."""
    rows = table(spark, sf, "events").select("event_id", (F.col("event_type") != "click").alias("ok"))
    end = rows.where("ok").orderBy("event_id").limit(500).agg(F.max("event_id").alias("end"), F.count("*").alias("accepted"))
    checked = rows.join(F.broadcast(end), F.col("event_id") <= F.col("end")).agg(F.count("*").alias("checked"), F.first("accepted").alias("accepted"))
    return checked.select("checked", "accepted", (F.col("checked") - F.col("accepted")).alias("rejected"))


_BOXES = "(VALUES ('west', 0, -30.0, 30.0, -180.0, 0.0), ('north', 1, 10.0, 90.0, -180.0, 180.0), ('east', 2, -30.0, 30.0, 0.0, 180.0)) b(name, rank, lat_lo, lat_hi, lon_lo, lon_hi)"
_POINTS = "(SELECT s_suppkey AS id, ((s_suppkey * 37) % 181 - 90)::DOUBLE AS lat, ((s_suppkey * 71) % 361 - 180)::DOUBLE AS lon FROM supplier)"


@query(f"SELECT id, coalesce(min_by(name, rank), 'other') AS city FROM {_POINTS} p LEFT JOIN {_BOXES} ON lat BETWEEN lat_lo AND lat_hi AND lon BETWEEN lon_lo AND lon_hi GROUP BY 1")
def bbox_assign(spark, sf):
    """Points made of supplier numbers; three literal boxes, the first that holds a point wins."""
    points = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37) % 181 - 90).cast("double").alias("lat"), ((F.col("s_suppkey") * 71) % 361 - 180).cast("double").alias("lon"))
    boxes = spark.createDataFrame([("west", 0, -30.0, 30.0, -180.0, 0.0), ("north", 1, 10.0, 90.0, -180.0, 180.0), ("east", 2, -30.0, 30.0, 0.0, 180.0)], "name string, rank int, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    return rel.first_box(points, boxes)


@query("SELECT n_name AS city, i::INT AS row, j::INT AS col FROM nation, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 3)) AS j)")
def tile_grid(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("city"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    return rows.select("city", "row", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))


@query("""WITH RECURSIVE e AS (SELECT 'all' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
t AS (SELECT 'all' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM t JOIN e ON node = parent WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM t GROUP BY 1""")
def category_bfs(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "region").select(F.lit("all").alias("parent"), s("r", "r_regionkey").alias("child"))
    edges = edges.unionByName(table(spark, sf, "nation").select(s("r", "n_regionkey").alias("parent"), s("n", "n_nationkey").alias("child")))
    edges = edges.unionByName(table(spark, sf, "supplier").select(s("n", "s_nationkey").alias("parent"), s("s", "s_suppkey").alias("child")))
    return rel.breadth_first(edges, spark.createDataFrame([("all",)], "node string"), 3)


_V = "v AS (SELECT s_nationkey AS variant, round(avg(s_acctbal), 6) AS acc, round(min(s_acctbal), 6) AS lat, count(*) AS cost FROM supplier GROUP BY 1)"


@query(f"WITH {_V} SELECT variant FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.acc >= a.acc AND b.lat <= a.lat AND b.cost <= a.cost AND (b.acc > a.acc OR b.lat < a.lat OR b.cost < a.cost))")
def pareto_front(spark, sf):
    """Variants that no other beats; nations are few, whatever the number of suppliers."""
    v = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("variant")).agg(F.round(F.avg("s_acctbal"), 6).alias("acc"), F.round(F.min("s_acctbal"), 6).alias("lat"), F.count("*").alias("cost"))
    a, b = v.alias("a"), v.alias("b")
    return a.join(F.broadcast(b), F.expr("b.acc >= a.acc AND b.lat <= a.lat AND b.cost <= a.cost AND (b.acc > a.acc OR b.lat < a.lat OR b.cost < a.cost)"), "left_anti").select("variant")


@query(f"WITH {_V} SELECT max_by(variant, acc * 1000 - variant) AS winner, max(lat) FILTER (WHERE cost >= 3) AS floor, count_if(cost >= 3) AS eligible FROM v WHERE cost >= 2")
def rule_winner(spark, sf):
    v = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("variant")).agg(F.round(F.avg("s_acctbal"), 6).alias("acc"), F.round(F.min("s_acctbal"), 6).alias("lat"), F.count("*").alias("cost"))
    return v.where("cost >= 2").agg(F.max_by("variant", F.col("acc") * 1000 - F.col("variant")).alias("winner"), F.max(F.when(F.col("cost") >= 3, F.col("lat"))).alias("floor"), F.count_if(F.col("cost") >= 3).alias("eligible"))


@query("""WITH b AS (SELECT * FROM (VALUES ('1-1', 0), ('1-2', 0), ('1-2', 1), ('all', 0), ('all', 1), ('all', 2)) v(cohort, label)) SELECT cohort, count(*) AS n, round(sum(vec_id) / nullif(count(*), 0), 6) AS rate FROM b JOIN (SELECT vec_id, label % 3 AS label FROM embeddings) USING (label) GROUP BY 1""")
def cohort_rollup(spark, sf):
    """Overlapping cohorts by a bridge of cohort and group."""
    bridge = spark.createDataFrame([("1-1", 0), ("1-2", 0), ("1-2", 1), ("all", 0), ("all", 1), ("all", 2)], "cohort string, label int")
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"))
    return rows.join(F.broadcast(bridge), "label").groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.sum("vec_id") / F.count("*"), 6).alias("rate"))


@query("SELECT quality = 1 AS before, toxic = 0 AS after, count(*) AS n FROM labels GROUP BY 1, 2")
def arm_flips(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("quality") == 1).alias("before"), (F.col("toxic") == 0).alias("after")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count_if(d.doc_id IS NULL) AS orphans, count_if(l.doc_id IS NULL) AS unlabelled, count_if(quality IS NULL AND l.doc_id IS NOT NULL) AS holes FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def referential_audit(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("d"))
    full = d.join(table(spark, sf, "labels"), F.col("d") == F.col("doc_id"), "full")
    return full.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("orphans"), F.count_if(F.col("doc_id").isNull()).alias("unlabelled"), F.count_if(F.col("quality").isNull() & F.col("doc_id").isNotNull()).alias("holes"))


@query("SELECT count(*) = count(DISTINCT (conv_id, turn)) AS unique_keys, count(*) AS n, count_if(role NOT IN ('user', 'assistant', 'system')) AS strange FROM conversations")
def key_uniqueness(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("c"), F.count_if(~F.col("role").isin("user", "assistant", "system")).alias("s"))
    return c.agg((F.max("c") == 1).alias("unique_keys"), F.sum("c").alias("n"), F.sum("s").alias("strange"))


@query("SELECT (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 4 AS batch, s_nationkey AS city, s_suppkey AS id FROM supplier")
def fixed_batches(spark, sf):
    r = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, sf, "supplier").select(F.floor((r - 1) / 4).alias("batch"), F.col("s_nationkey").alias("city"), F.col("s_suppkey").alias("id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def star_join(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def star_semi_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    kept = c.join(o.where("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def star_topk(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", rank).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def n_worst(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT coalesce(o_orderpriority, 'ALL') AS priority, coalesce(o_orderstatus, 'ALL') AS status, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def star_rollup(spark, sf):
    return table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), "n")


@query("SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)")
def star_setops(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("intersect", a.intersect(b)), ("except_all", a.exceptAll(b)), ("intersect_all", a.intersectAll(b))]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LIC = "(VALUES ('CC BY-SA 4.0', ''), ('cc0', ''), ('CC BY 3.0', ''), ('', 'pd-old-70'), ('Public domain', ''), ('All rights reserved', ''), ('CC BY-NC 4.0', 'x'), ('  CC  BY-SA  2.0 ', ''))"


@query(rf"""SELECT a, CASE WHEN regexp_matches(t, '^cc0\b|^cc[- ]zero\b') THEN 'CC0' WHEN regexp_matches(t, '^cc[- ]by[- ]sa[- ]?\d') THEN 'CC BY-SA' WHEN regexp_matches(t, '^cc[- ]by[- ]?\d') THEN 'CC BY' WHEN regexp_matches(t, '^pd(\b|-)|^public domain\b') THEN 'PD'
WHEN regexp_matches(m, '^pd(\b|-)') THEN 'PD' END AS kind FROM (SELECT a, lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) AS t, lower(m) AS m FROM {_LIC} v(a, m))""")
def licence_canonical(spark, sf):
    rows = [("CC BY-SA 4.0", ""), ("cc0", ""), ("CC BY 3.0", ""), ("", "pd-old-70"), ("Public domain", ""), ("All rights reserved", ""), ("CC BY-NC 4.0", "x"), ("  CC  BY-SA  2.0 ", "")]
    return spark.createDataFrame(rows, "a string, m string").select("a", text.licence_class("a", "m").alias("kind"))
