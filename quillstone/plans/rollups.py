"""Queries of filters, paging, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import aggregates as ag
from quillstone.operators import filters, paging
from quillstone.plans.registry import query
from quillstone.plans.tables import table


@query("ag01_kpi_rollup", """
SELECT count(*)::BIGINT AS total, count(DISTINCT l_orderkey)::BIGINT AS units,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS accepted,
  sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS neither, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_lines,
  sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS final_lines, sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted,
  sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)::BIGINT AS full_price, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)::BIGINT AS large
FROM lineitem""")
def ag01(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    conditions = {
        "returned": c("l_returnflag") == "R", "accepted": c("l_returnflag") == "A", "neither": c("l_returnflag") == "N", "open_lines": c("l_linestatus") == "O",
        "final_lines": c("l_linestatus") == "F", "discounted": c("l_discount") >= 0.05, "full_price": c("l_discount") == 0, "large": c("l_quantity") > 40,
    }
    return ag.kpi_row(table(spark, sf, "lineitem"), "l_orderkey", conditions)


@query("ag02_status_breakdown", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def ag02(spark, sf):
    return ag.breakdown(table(spark, sf, "events"), "event_type")


@query("ag03_confidence_breakdown", "SELECT quality, toxic, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def ag03(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


FACETS = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE (d.text ILIKE '%tion%' OR d.source ILIKE '%tion%') AND d.lang IN ('en', 'fr') AND l.quality = 1 AND d.text <> ''"""


def _facets(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.faceted(docs, " tion ", ["text", "source"], {"lang": "en,fr", "source": None}, {"quality": 1}, {"text": True}).select("doc_id", "lang", "source", "n_chars", "quality")


@query("f01_faceted_search", f"SELECT * FROM ({FACETS}) ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def f01(spark, sf):
    order = paging.ordering("n_chars", "desc", ["doc_id", "n_chars", "source"], "doc_id", "doc_id")
    return paging.page(_facets(spark, sf), order, 2, 25)


@query("st02_page_count", f"SELECT count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages FROM ({FACETS})")
def st02(spark, sf):
    return paging.page_count(_facets(spark, sf), 25)


@query("f04_tristate_flags", """
SELECT 'true' AS want, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1
UNION ALL SELECT 'false', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 0
UNION ALL SELECT 'all', count(*) FROM documents LEFT JOIN labels USING (doc_id)""")
def f04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("flagged", F.col("toxic") == 1)
    each = [(w, d.filter(filters.flag("flagged", v))) for w, v in (("true", True), ("false", False), ("all", None))]
    out = None
    for w, df in each:
        one = df.agg(F.count("*").alias("n")).select(F.lit(w).alias("want"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("f05_presence", """
SELECT 'present' AS want, count(*)::BIGINT AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%') ON c_custkey = o_custkey WHERE o_orderpriority <> ''
UNION ALL SELECT 'absent', count(*) FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%') ON c_custkey = o_custkey WHERE o_orderpriority = '' OR o_orderpriority IS NULL""")
def f05(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_custkey", "o_orderpriority").distinct()
    c = table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    one = lambda w, v: c.filter(filters.present("o_orderpriority", v)).agg(F.count("*").alias("n")).select(F.lit(w).alias("want"), "n")
    return one("present", True).unionByName(one("absent", False))


@query("f07_point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def f07(spark, sf):
    return table(spark, sf, "documents").filter("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("f13_first_probe", """
WITH p AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_name = 'no such name' THEN 0 WHEN s_nationkey = 7 THEN 1 WHEN s_acctbal > 0 THEN 2 END AS k FROM supplier)
SELECT s_suppkey, s_name, s_nationkey FROM p WHERE k = (SELECT min(k) FROM p)""")
def f13(spark, sf):
    s = table(spark, sf, "supplier")
    return filters.first_matching_probe(s, [F.col("s_name") == "no such name", F.col("s_nationkey") == 7, F.col("s_acctbal") > 0]).select("s_suppkey", "s_name", "s_nationkey")


SUMMARY = """
SELECT l_orderkey, arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag)) AS l_shipdate, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag)) AS l_returnflag,
  count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS n_returned, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS n_open
FROM lineitem GROUP BY 1"""


def _summary(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("ordinal", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"))
    counts = {"n_lines": F.lit(True), "n_returned": F.col("l_returnflag") == "R", "n_open": F.col("l_linestatus") == "O"}
    return ag.group_summary(lines, "l_orderkey", "ordinal", ["l_shipdate", "l_returnflag"], counts)


@query("ag04_document_summary", SUMMARY)
def ag04(spark, sf):
    return _summary(spark, sf)


@query("ag05_corpus_stats", f"""
SELECT count(*)::BIGINT AS n_orders, sum(n_lines)::BIGINT AS n_lines, round(coalesce(avg(n_lines), 0), 2) AS avg_lines, round(coalesce(avg(100.0 * n_returned / n_lines), 0), 1) AS avg_returned_pct,
  count(*) FILTER (WHERE n_returned >= 3)::BIGINT AS high, count(*) FILTER (WHERE n_returned BETWEEN 1 AND 2)::BIGINT AS medium, count(*) FILTER (WHERE n_returned = 0)::BIGINT AS low
FROM ({SUMMARY})""")
def ag05(spark, sf):
    risk = ag.risk(F.col("n_returned"), F.lit(0))
    return _summary(spark, sf).withColumn("risk", risk).agg(
        F.count("*").alias("n_orders"), F.sum("n_lines").alias("n_lines"), F.round(F.coalesce(F.avg("n_lines"), F.lit(0.0)), 2).alias("avg_lines"),
        F.round(F.coalesce(F.avg(100.0 * F.col("n_returned") / F.col("n_lines")), F.lit(0.0)), 1).alias("avg_returned_pct"),
        F.count_if(F.col("risk") == "HIGH").alias("high"), F.count_if(F.col("risk") == "MEDIUM").alias("medium"), F.count_if(F.col("risk") == "LOW").alias("low"),
    )


RECENCY = """
WITH years AS (SELECT c_custkey, year(o_orderdate) AS y, max(year(o_orderdate)) OVER (PARTITION BY c_custkey) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, coalesce(round(100.0 * count(*) FILTER (WHERE y >= b - 2) / nullif(count(y), 0), 1), 0.0)::DOUBLE AS recency_index,
  round(greatest(0.0::DOUBLE, max(b) - median(y)), 1) AS median_age, min(y)::INTEGER AS first_year, max(y)::INTEGER AS last_year, count(y)::BIGINT AS n_years
FROM years GROUP BY 1"""


def _order_years(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    rows = c.select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderkey")
    return rows.withColumn("b", F.max("y").over(Window.partitionBy("c_custkey")))


@query("ag07_recency_index", RECENCY)
def ag07(spark, sf):
    return ag.recency(_order_years(spark, sf), "c_custkey", "y", "b", window=2)


@query("ag09_entropy", """
WITH per AS (SELECT c_custkey, o_orderpriority, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
h AS (SELECT c_custkey, count(*) AS k, sum(n) AS total, -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY c_custkey)::DOUBLE AS t FROM per) GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN k < 2 OR total < 2 THEN 1.0::DOUBLE ELSE round(h / ln(k), 2) END, 0.0::DOUBLE) AS diversity, coalesce(k, 0)::BIGINT AS n_values
FROM customer LEFT JOIN h USING (c_custkey)""")
def ag09(spark, sf):
    return ag.diversity(_order_years(spark, sf), "c_custkey", "o_orderpriority")


@query("ag10_primary_category", """
WITH c AS (SELECT p_brand, p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 'CRITIQUE' WHEN contains(lower(p_type), 'standard') OR contains(lower(p_type), 'medium') THEN 'COMPARISON'
  WHEN contains(lower(p_type), 'economy') THEN 'METHODOLOGY' ELSE 'BACKGROUND' END AS category FROM part),
per AS (SELECT p_brand, category, count(*) AS n, min(p_partkey) AS seen FROM c GROUP BY ALL)
SELECT p_brand, arg_max(category, n * 1000000000 - seen) AS primary_category, max(n)::BIGINT AS n FROM per GROUP BY 1""")
def ag10(spark, sf):
    from quillstone.functions.ladders import by_words

    rules = (("CRITIQUE", ("promo",)), ("COMPARISON", ("standard", "medium")), ("METHODOLOGY", ("economy",)))
    parts = table(spark, sf, "part").withColumn("category", by_words(F.col("p_type"), rules, "BACKGROUND"))
    out = ag.primary_category(parts, "p_brand", "category", "p_partkey")
    return out.select("p_brand", F.col("primary").alias("primary_category"), F.array_max(F.map_values("distribution")).alias("n"))


SUPPLIERS = """
SELECT s_suppkey, count(l_orderkey)::BIGINT AS total, (count(*) FILTER (WHERE l_discount >= 0.1) // 20)::BIGINT AS invalid, (count(*) FILTER (WHERE l_quantity = 50) // 8)::BIGINT AS discrepancies,
  coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag <> 'R') / nullif(count(l_orderkey), 0), 1), 0) AS resolving, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE l_linestatus = 'F') / nullif(count(l_orderkey), 0), 1), 0) AS linked
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"""


@query("ag11_risk_grade", f"""
SELECT *, CASE WHEN invalid >= 3 THEN 'HIGH' WHEN invalid >= 1 OR discrepancies >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN linked >= 50 THEN 'CUTTING_EDGE' WHEN linked >= 25 THEN 'BALANCED' ELSE 'DATED_OBSOLESCENT' END AS freshness,
  CASE WHEN invalid >= 3 THEN 'REQUIRES_REVISION' WHEN invalid >= 1 OR discrepancies >= 2 THEN 'C' WHEN resolving >= 90 AND linked >= 85 THEN CASE WHEN linked >= 40 THEN 'A+' ELSE 'A' END
    WHEN resolving >= 75 OR linked >= 70 THEN 'B' WHEN resolving >= 50 THEN 'C' ELSE 'REQUIRES_REVISION' END AS grade
FROM ({SUPPLIERS})""")
def ag11(spark, sf):
    s, lines = table(spark, sf, "supplier").select("s_suppkey"), table(spark, sf, "lineitem")
    pct = lambda c: F.coalesce(F.round(100.0 * F.count_if(c) / F.nullif(F.count("l_orderkey"), F.lit(0)), 1), F.lit(0.0))
    per = s.join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(
        F.count("l_orderkey").alias("total"), F.floor(F.count_if(F.col("l_discount") >= 0.1) / 20).alias("invalid"), F.floor(F.count_if(F.col("l_quantity") == 50) / 8).alias("discrepancies"),
        pct(F.col("l_returnflag") != "R").alias("resolving"), pct(F.col("l_linestatus") == "F").alias("linked"),
    )
    c = F.col
    return per.withColumns({"risk": ag.risk(c("invalid"), c("discrepancies")), "freshness": ag.freshness(c("linked")), "grade": ag.grade(c("invalid"), c("discrepancies"), c("resolving"), c("linked"), c("linked"))})


@query("ag17_run_statistics", """
SELECT o_custkey % 10 AS batch, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS "F", count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS "O", count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS "P", count(*)::BIGINT AS total
FROM orders GROUP BY 1""")
def ag17(spark, sf):
    o = table(spark, sf, "orders").withColumn("batch", F.col("o_custkey") % 10)
    return o.groupBy("batch").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in ("F", "O", "P")], F.count("*").alias("total"))


@query("ag18_segmentation_stats", """
WITH per AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS parts, round(avg(n), 2) AS avg_all, round(avg(n) FILTER (WHERE n > 0), 2) AS avg_filled, min(n) FILTER (WHERE n > 0)::BIGINT AS least, max(n)::BIGINT AS most FROM per""")
def ag18(spark, sf):
    o, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    per = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    filled = F.when(F.col("n") > 0, F.col("n"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("parts"), F.round(F.avg("n"), 2).alias("avg_all"), F.round(F.avg(filled), 2).alias("avg_filled"), F.min(filled).alias("least"), F.max("n").alias("most"))


@query("ag22_consistency", """
WITH c AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS cited, least(7, 1 + l_orderkey % 9)::INTEGER AS n_listed FROM lineitem GROUP BY 1, 3),
s AS (SELECT l_orderkey, cited, range(1, n_listed + 1) AS listed FROM c)
SELECT l_orderkey, len(list_filter(listed, lambda x: NOT list_contains(cited, x)))::INTEGER AS n_orphans, len(list_filter(cited, lambda x: NOT list_contains(listed, x)))::INTEGER AS n_missing,
  len(list_filter(range(1, list_max(cited) + 1), lambda x: NOT list_contains(cited, x)))::INTEGER AS n_gaps,
  round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - (1.5::DOUBLE * len(list_filter(listed, lambda x: NOT list_contains(cited, x))) + 3 * len(list_filter(cited, lambda x: NOT list_contains(listed, x)))) / greatest(1, len(listed)) * 100)), 1) AS score
FROM s""")
def ag22(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("cited"))
    listed = F.sequence(F.lit(1).cast("long"), F.least(F.lit(7), 1 + F.col("l_orderkey") % 9).cast("long"))
    out = lines.select("l_orderkey", ag.consistency(F.col("cited"), listed).alias("c"))
    return out.select("l_orderkey", F.size("c.orphans").alias("n_orphans"), F.size("c.missing").alias("n_missing"), F.size("c.gaps").alias("n_gaps"), "c.score")


@query("ag25_rollup", """
WITH s AS (SELECT l_orderkey, list_distinct(list(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'VERIFIED' WHEN l_returnflag = 'A' THEN 'PARTIALLY_VERIFIED' WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'BLOCKED'
  WHEN l_returnflag = 'R' THEN 'NOT_REPRODUCED' WHEN l_quantity > 40 THEN 'INCONCLUSIVE' ELSE 'VERIFIED' END)) AS st FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_contains(st, 'BLOCKED') THEN 'BLOCKED' WHEN len(st) = 0 OR list_contains(st, 'INCONCLUSIVE') THEN 'INCONCLUSIVE'
  WHEN list_contains(st, 'VERIFIED') AND list_contains(st, 'NOT_REPRODUCED') THEN 'INCONCLUSIVE' WHEN list_contains(st, 'NOT_REPRODUCED') THEN 'NOT_REPRODUCED'
  WHEN list_contains(st, 'PARTIALLY_VERIFIED') THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END AS verdict FROM s""")
def ag25(spark, sf):
    flag, line, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    status = F.when((flag == "A") & (line == "O"), "VERIFIED").when(flag == "A", "PARTIALLY_VERIFIED").when((flag == "R") & (n > 45), "BLOCKED").when(flag == "R", "NOT_REPRODUCED").when(n > 40, "INCONCLUSIVE").otherwise("VERIFIED")
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(status).alias("statuses"))
    return per.select("l_orderkey", ag.verdict(F.col("statuses")).alias("verdict"))


@query("ag27_target_score", """
SELECT p_partkey, ((p_size > 10)::INTEGER + (p_retailprice > 1000)::INTEGER + (p_brand LIKE '%1')::INTEGER + (p_type = 'PROMO')::INTEGER + (length(p_name) > 10)::INTEGER)::INTEGER AS score,
  list_filter(['size', 'price', 'brand', 'type', 'name'], lambda x: CASE x WHEN 'size' THEN p_size > 10 WHEN 'price' THEN p_retailprice > 1000 WHEN 'brand' THEN p_brand LIKE '%1' WHEN 'type' THEN p_type = 'PROMO' ELSE length(p_name) > 10 END)::VARCHAR AS dimensions
FROM part""")
def ag27(spark, sf):
    c = F.col
    dims = {"size": c("p_size") > 10, "price": c("p_retailprice") > 1000, "brand": c("p_brand").endswith("1"), "type": c("p_type") == "PROMO", "name": F.length("p_name") > 10}
    held = F.array_compact(F.array(*[F.when(v, k) for k, v in dims.items()]))
    return table(spark, sf, "part").select("p_partkey", F.size(held).alias("score"), F.concat(F.lit("["), F.array_join(held, ", "), F.lit("]")).alias("dimensions"))


@query("ag28_domain", """
WITH w AS (SELECT * FROM (VALUES ('NORTH', 'the'), ('NORTH', 'and'), ('SOUTH', 'que'), ('SOUTH', 'los'), ('EAST', 'der'), ('EAST', 'und'), ('WEST', 'les'), ('WEST', 'aux')) v(domain, word)),
s AS (SELECT doc_id, domain, sum(CASE WHEN contains(lower(coalesce(text, '')), word) THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(lang, '')), word) THEN 5 ELSE 0 END)::BIGINT AS score FROM documents, w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS k, score - lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS margin FROM s)
SELECT doc_id, CASE WHEN score = 0 THEN 'UNKNOWN' ELSE domain END AS domain, score, CASE WHEN margin >= 6 THEN 'HIGH' WHEN margin >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r WHERE k = 1""")
def ag28(spark, sf):
    words = spark.createDataFrame([("NORTH", "the"), ("NORTH", "and"), ("SOUTH", "que"), ("SOUTH", "los"), ("EAST", "der"), ("EAST", "und"), ("WEST", "les"), ("WEST", "aux")], "domain string, word string")
    s = ag.domain_scores(table(spark, sf, "documents"), "doc_id", {"text": 3, "lang": 5}, words)
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "domain")
    r = s.withColumns({"k": F.row_number().over(w), "margin": F.col("score") - F.lead("score").over(w)}).filter("k = 1")
    return r.select("doc_id", F.when(F.col("score") == 0, "UNKNOWN").otherwise(F.col("domain")).alias("domain"), "score", F.when(F.col("margin") >= 6, "HIGH").when(F.col("margin") >= 3, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("ag29_conflicts", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, lower(trim(l_returnflag)) AS v FROM lineitem),
bad AS (SELECT l_orderkey, count(DISTINCT v)::BIGINT AS n_values FROM v GROUP BY 1 HAVING count(DISTINCT v) > 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, n_values FROM v JOIN bad USING (l_orderkey)""")
def ag29(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return ag.conflicts(lines, "l_orderkey", F.lower(F.trim("l_returnflag")))


@query("ag29_resolved", """
SELECT l_orderkey, count(DISTINCT lower(trim(l_returnflag)))::BIGINT AS n_values, CASE WHEN count(DISTINCT lower(trim(l_returnflag))) = 1 THEN min(lower(trim(l_returnflag))) END AS value FROM lineitem GROUP BY 1""")
def ag29b(spark, sf):
    return ag.resolved(table(spark, sf, "lineitem"), "l_orderkey", F.lower(F.trim("l_returnflag")))


@query("ag32_hypothesis_fold", """
WITH o AS (SELECT user_id, list_distinct(list(CASE WHEN value < 20 THEN 'SUPPORTING' WHEN value > 180 THEN 'CONTRADICTING' WHEN value > 150 THEN 'BLOCKED' ELSE 'NONE' END)) AS s FROM events GROUP BY 1)
SELECT user_id, CASE WHEN list_contains(s, 'SUPPORTING') AND list_contains(s, 'CONTRADICTING') THEN 'INCONCLUSIVE' WHEN list_contains(s, 'SUPPORTING') AND list_contains(s, 'BLOCKED') THEN 'WEAKLY_SUPPORTED'
  WHEN list_contains(s, 'SUPPORTING') THEN 'SUPPORTED' WHEN list_contains(s, 'CONTRADICTING') THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS status FROM o""")
def ag32(spark, sf):
    v = F.col("value")
    outcome = F.when(v < 20, "SUPPORTING").when(v > 180, "CONTRADICTING").when(v > 150, "BLOCKED").otherwise("NONE")
    per = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(outcome).alias("s"))
    return per.select("user_id", ag.hypothesis_status(F.col("s")).alias("status"))


@query("ag34_merge", """
SELECT conv_id, arg_min(role, turn) FILTER (WHERE role IS NOT NULL) AS role, arg_max(text, length(text) * 1000000 - turn) AS text FROM conversations GROUP BY 1""")
def ag34(spark, sf):
    return ag.merge_parts(table(spark, sf, "conversations"), "conv_id", "turn", ["role"], ["text"])


@query("ag35_discriminative_terms", """
WITH t AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM benchmark)
SELECT term, min(item_id) AS item_id FROM t GROUP BY 1 HAVING count(DISTINCT item_id) = 1""")
def ag35(spark, sf):
    from quillstone.functions.text import terms

    t = table(spark, sf, "benchmark").select("item_id", F.explode(terms(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n")).filter("n = 1").drop("n")


@query("ag37_headers", """
WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
p AS (SELECT source, count(*) AS pages FROM l GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT source, doc_id, lines[1] AS line FROM l UNION SELECT source, doc_id, lines[len(lines)] FROM l)
SELECT source, line, count(*)::BIGINT AS n, pages::BIGINT AS pages FROM e JOIN p USING (source) WHERE line IS NOT NULL GROUP BY source, line, pages HAVING count(*) >= 2 AND count(*) >= greatest(2, pages // 20)""")
def ag37(spark, sf):
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf, "documents").select("source", "doc_id", F.get(lines, F.lit(0)).alias("head"), F.get(lines, F.size(lines) - 1).alias("foot"))
    pages = d.groupBy("source").agg(F.count("*").alias("pages")).filter("pages >= 3")
    ends = d.select("source", "doc_id", F.explode(F.array_distinct(F.array_compact(F.array("head", "foot")))).alias("line"))
    return ends.groupBy("source", "line").agg(F.count("*").alias("n")).join(pages, "source").filter("n >= greatest(2, pages div 20)")


@query("st06_topk", """
WITH c AS (SELECT p_type, p_brand, count(*)::BIGINT AS n, min(p_partkey) AS seen FROM part GROUP BY ALL)
SELECT p_type, p_brand, n, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, seen) AS k FROM c) WHERE k <= 3""")
def st06(spark, sf):
    c = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    return paging.top_of_group(c, ["p_type"], [F.col("n").desc(), F.col("seen")], 3).drop("seen")


@query("st04_top_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def st04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


@query("so01_except_both_ways", """
SELECT doc_id, 'UNLABELLED' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'ORPHAN' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def so01(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.subtract(lab).withColumn("side", F.lit("UNLABELLED")).unionByName(lab.subtract(d).withColumn("side", F.lit("ORPHAN")))


@query("so03_jaccard", """
WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 4) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def so03(spark, sf):
    from quillstone.functions.fuzzy import jaccard
    from quillstone.functions.text import terms

    t = table(spark, sf, "benchmark").select("item_id", terms(F.col("text"), least=1).alias("w"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return t.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(jaccard(F.col("w"), F.col("v")), 4).alias("jaccard"))


@query("so06_override_union", """
SELECT coalesce(a.c_custkey, b.o_custkey) AS custkey, coalesce(b.status, a.status) AS status FROM (SELECT c_custkey, 'EMBEDDED' AS status FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT DISTINCT o_custkey, 'AUTHORITATIVE' AS status FROM orders WHERE o_orderstatus = 'P') b ON a.c_custkey = b.o_custkey""")
def so06(spark, sf):
    a = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"), F.lit("EMBEDDED").alias("embedded"))
    b = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")).distinct().withColumn("authoritative", F.lit("AUTHORITATIVE"))
    return a.join(b, "custkey", "full_outer").select("custkey", F.coalesce("authoritative", "embedded").alias("status"))
