"""Queries of joins, windows, changing tables and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.fuzzy import jaccard
from quillstone.functions.text import terms
from quillstone.operators import paging, state, windows
from quillstone.plans.registry import query
from quillstone.plans.tables import table


@query("jn01_pending", """
SELECT doc_id, 'PENDING' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'COMPLETED' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def jn01(spark: SparkSession, sf: str) -> DataFrame:
    d, done = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(done, "doc_id", "left_anti").withColumn("state", F.lit("PENDING")).unionByName(d.join(done, "doc_id", "left_semi").withColumn("state", F.lit("COMPLETED")))


@query("jn02_positional", """
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS k FROM lineitem WHERE l_linenumber = 1) WHERE k = 1)
SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def jn02(spark, sf):
    first = table(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.max(F.struct("l_partkey", "l_suppkey")).alias("last"))
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "last.l_partkey", "last.l_suppkey")


@query("jn03_nearest")
def jn03(spark, sf):
    """Nearest item of every document, however long."""
    return nearest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def nearest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Nearest item by word overlap. Pairs are made over shared words, whose lists the rarest words keep short.

    Where the word counts alone keep the overlap below the limit, no pair is made: the share of common words is
    at most the smaller count over the larger one.
    """
    d = docs.select("doc_id", terms(F.col("text")).alias("w")).withColumn("nd", F.size("w"))
    t = items.select("item_id", terms(F.col("text")).alias("v")).withColumn("nt", F.size("v"))
    both = d.select("doc_id", "nd", F.explode("w").alias("word")).join(t.select("item_id", "nt", F.explode("v").alias("word")), "word")
    both = both.filter(F.least("nd", "nt") >= 0.1499 * F.greatest("nd", "nt"))
    p = both.groupBy("doc_id", "item_id", "nd", "nt").agg(F.count("*").alias("n")).select("doc_id", "item_id", F.round(F.col("n") / (F.col("nd") + F.col("nt") - F.col("n")), 4).alias("similarity"))
    best = p.filter("similarity >= 0.15").groupBy("doc_id").agg(F.max(F.struct("similarity", -F.col("item_id"))).alias("b"))
    return best.select("doc_id", (-F.col("b.col2")).alias("item_id"), "b.similarity")


@query("jn07_topk_theta", """
WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS w FROM benchmark),
c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS w FROM conversations),
p AS (SELECT conv_id, turn, item_id, len(list_intersect(c.w, t.w)) AS n, len(list_distinct(list_concat(c.w, t.w))) AS u FROM c, t),
s AS (SELECT conv_id, turn, item_id, round(n::DOUBLE / u, 4) AS similarity FROM p WHERE n > 0 AND round(n::DOUBLE / u, 4) >= 0.12)
SELECT conv_id, turn, item_id, similarity, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, item_id) AS k FROM s) WHERE k <= 3""")
def jn07(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", terms(F.col("text")).alias("w")).withColumn("nc", F.size("w"))
    t = table(spark, sf, "benchmark").select("item_id", terms(F.col("text")).alias("v")).withColumn("nt", F.size("v"))
    both = c.select("conv_id", "turn", "nc", F.explode("w").alias("word")).join(t.select("item_id", "nt", F.explode("v").alias("word")), "word")
    p = both.groupBy("conv_id", "turn", "item_id", "nc", "nt").agg(F.count("*").alias("n"))
    s = p.select("conv_id", "turn", "item_id", F.round(F.col("n") / (F.col("nc") + F.col("nt") - F.col("n")), 4).alias("similarity")).filter("similarity >= 0.12")
    return paging.top_of_group(s, ["conv_id", "turn"], [F.col("similarity").desc(), F.col("item_id")], 3)


@query("jn09_window_excerpt", """
SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS excerpt FROM conversations""")
def jn09(spark, sf):
    return windows.excerpt(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "excerpt")


@query("jn15_first_of_order", """
SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R'), l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def jn15(spark, sf):
    lines = table(spark, sf, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct((F.col("l_returnflag") == "R").alias("last"), "l_partkey", "l_suppkey")).alias("f"))
    return first.select("l_orderkey", "f.l_partkey", "f.l_suppkey")


@query("jn23_integrity", """
SELECT l_orderkey AS entity, 'MISSING_SUPPLIER' AS issue, count(*)::BIGINT AS n FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) s ON l_suppkey = s_suppkey WHERE s_suppkey IS NULL GROUP BY 1
UNION ALL SELECT o_orderkey, 'NO_LINES', 1 FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL""")
def jn23(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf, "supplier").filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("l_suppkey"))
    a = lines.join(s, "l_suppkey", "left_anti").groupBy(F.col("l_orderkey").alias("entity")).agg(F.count("*").alias("n")).select("entity", F.lit("MISSING_SUPPLIER").alias("issue"), "n")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"))
    b = o.join(lines.select(F.col("l_orderkey").alias("entity")).distinct(), "entity", "left_anti").select("entity", F.lit("NO_LINES").alias("issue"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b)


@query("jn28_nested_detail", """
SELECT o_orderkey, list(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey)::VARCHAR AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def jn28(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    text = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return nested.select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(text, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")).alias("lines"))


@query("wn01_claimed_once", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source, lower(lang || (n_chars % 7)::VARCHAR) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def wn01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.concat("lang", (F.col("n_chars") % 7).cast("string")).alias("identifier"))
    return windows.claimed_once(d, "source", "identifier", "doc_id").select("doc_id", "source", "duplicate")


@query("wn03_latest", """
SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def wn03(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return windows.latest(e, ["user_id", "event_type"], "ts", "event_id")


@query("wn05_keep_first", """
SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text))::BIGINT AS copies, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def wn05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


@query("wn06_keep_last_at_first", """
SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def wn06(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return windows.keep_last_at_first(e, ["user_id", "event_type"], "event_id")


@query("wn07_fan_out", """
WITH c AS (SELECT md5(text) AS k, min(doc_id) AS first_doc, max(length(text)) AS size FROM documents GROUP BY 1) SELECT doc_id, first_doc, size::BIGINT AS size FROM documents JOIN c ON md5(text) = k""")
def wn07(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("key", F.md5("text"))
    computed = d.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max(F.length("text")).cast("long").alias("size"))
    return windows.fan_out(d.drop("key"), F.md5("text"), computed, "key").select("doc_id", "first_doc", "size")


@query("wn10_target_rank", """
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size // 20, p_size % 5, length(p_name) DESC, p_partkey)::INTEGER AS rank FROM part WHERE p_retailprice > 950 AND p_type <> 'PROMO'""")
def wn10(spark, sf):
    p = table(spark, sf, "part").filter("p_retailprice > 950 and p_type <> 'PROMO'")
    p = p.select("p_partkey", "p_brand", F.expr("p_size div 20").alias("readiness"), (F.col("p_size") % 5).alias("missing"), F.length("p_name").alias("score"))
    return windows.target_rank(p, ["p_brand"], "readiness", "missing", "score", "p_partkey").select("p_partkey", "p_brand", "rank")


@query("wn13_context_budget", """
SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, doc_id) AS used FROM documents) WHERE used <= 40000""")
def wn13(spark, sf):
    w = Window.partitionBy("source").orderBy(F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2), "doc_id")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.withColumn("used", F.sum("n_chars").over(w)).filter("used <= 40000").select("doc_id", "source")


TRANSITIONS = "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS state FROM events"


def _moves(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    return windows.transitions(e, "user_id", ["ts", "event_id"], "state").select("user_id", "event_id", "previous", "state")


@query("wn15_transitions", TRANSITIONS)
def wn15(spark, sf):
    return _moves(spark, sf)


@query("dm08_illegal_moves", f"""
WITH m AS ({TRANSITIONS}) SELECT * FROM m WHERE previous IS NOT NULL AND previous <> state AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT a.event_type AS p, b.event_type AS s FROM events a, events b WHERE a.event_type < b.event_type) x WHERE x.p = m.previous AND x.s = m.state)""")
def dm08(spark, sf):
    types = table(spark, sf, "events").select("event_type").distinct()
    allowed = types.select(F.col("event_type").alias("previous")).join(types.select(F.col("event_type").alias("state")), F.col("previous") < F.col("state"))
    return windows.illegal(_moves(spark, sf), allowed).select("user_id", "event_id", "previous", "state")


@query("dm01_upsert", """
SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'NEW', o_custkey + 1 FROM orders WHERE o_orderkey % 3 = 0""")
def dm01(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("NEW").alias("o_orderstatus"), (F.col("o_custkey") + 1).alias("o_custkey"))
    return state.upsert(o.filter("o_orderkey % 2 = 0"), new, ["o_orderkey"])


@query("dm02_insert_ignore", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'NEW' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0""")
def dm02(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return state.insert_or_ignore(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("NEW").alias("o_orderstatus")), ["o_orderkey"])


@query("dm04_review_overlay", """
SELECT doc_id, quality IS NOT NULL AS reviewed_by_user, coalesce('note ' || doc_id, '') AS user_notes, CASE WHEN toxic = 1 THEN 'TOXIC' ELSE lang END AS final_status
FROM (SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id::VARCHAR END AS n FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, false, '', lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def dm04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("final_status"))
    r = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("notes"), F.when(F.col("toxic") == 1, "TOXIC").otherwise("").alias("status"))
    return state.review_overlay(d, r, "doc_id").select("doc_id", "reviewed_by_user", "user_notes", "final_status")


@query("dm07_versions", """
WITH h AS (SELECT source, sha256(text) AS content_hash, min(doc_id) AS first_doc FROM documents GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_doc) AS version FROM h)
SELECT doc_id, documents.source, version::INTEGER AS version FROM documents JOIN v ON v.source = documents.source AND v.content_hash = sha256(text)""")
def dm07(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return state.versions(d, "source", F.sha2("text", 256), ["doc_id"]).select("doc_id", "source", "version")


@query("dm10_lease", """
SELECT user_id, max(ts) AS heartbeat, CASE WHEN max(ts) + INTERVAL 60 SECOND <= TIMESTAMP '2024-01-30 12:00:00' THEN 'INTERRUPTED' ELSE 'ACTIVE' END AS lease FROM events GROUP BY 1""")
def dm10(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"))
    return e.withColumn("lease", state.lease_state(F.col("heartbeat"), F.expr("timestamp_ntz'2024-01-30 12:00:00'") if dict(e.dtypes)["heartbeat"] == "timestamp_ntz" else F.expr("timestamp'2024-01-30 12:00:00'")))


@query("dm12_bound_approvals", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '1998-01-01'""")
def dm12(spark, sf):
    o = table(spark, sf, "orders")
    key = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256).alias("request_hash")
    approvals = o.filter("o_orderkey % 4 = 0").select("o_orderkey", key, F.col("o_orderdate").alias("expires_at"), (F.col("o_orderstatus") == "P").alias("revoked"))
    return state.bound_approvals(approvals, o.select("o_orderkey", key), "o_orderkey", ["request_hash"], F.lit("1998-01-01").cast(dict(o.dtypes)["o_orderdate"])).select("o_orderkey")


@query("ext_tumbling", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def ext_tumbling(spark, sf):
    """Extension: tumbling windows of six hours."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


@query("ext_session", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, sf):
    """Extension: sessions with a gap of two hours."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")
