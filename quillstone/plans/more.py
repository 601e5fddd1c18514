"""Further joins, sets, orders and text functions of the survey, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import identifiers, text
from quillstone.operators import state
from quillstone.plans.registry import query
from quillstone.plans.tables import table


@query("jn04_deposited_references", """
WITH d AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
u AS (SELECT c_custkey, unnest(range(1, 4)) AS n FROM customer)
SELECT u.c_custkey, u.n::BIGINT AS n, d.o_orderkey FROM u LEFT JOIN d ON d.o_custkey = u.c_custkey AND d.n = u.n AND d.total = 3""")
def jn04(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded and deposited references are matched by position only where their numbers are equal."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    numbered = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    same = o.groupBy("o_custkey").agg(F.count("*").alias("total")).filter("total = 3")
    deposited = numbered.join(same, "o_custkey").select(F.col("o_custkey").alias("c_custkey"), "n", "o_orderkey")
    uploaded = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("n"))
    return uploaded.join(deposited, ["c_custkey", "n"], "left")


@query("jn10_lookups", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def jn10(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("jn14_kept_mappings", """
SELECT l_orderkey, l_suppkey, count(*) FILTER (WHERE l_quantity > 45)::BIGINT AS relevant FROM lineitem GROUP BY ALL HAVING count(*) FILTER (WHERE l_quantity > 45) > 0 OR max(l_returnflag) = 'R'""")
def jn14(spark, sf):
    """A mapping stays if any file is relevant or it is directly associated."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count_if(F.col("l_quantity") > 45).alias("relevant"), F.max("l_returnflag").alias("f"))
    return g.filter("relevant > 0 or f = 'R'").drop("f")


@query("jn17_related_artifact", """
SELECT s_suppkey, arg_min(p_partkey, p_partkey) AS p_partkey FROM supplier JOIN part ON p_partkey % 100 = s_suppkey % 100 AND contains(lower(p_name), 'a') GROUP BY 1""")
def jn17(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100).alias("k"))
    p = table(spark, sf, "part").filter(F.lower("p_name").contains("a")).select("p_partkey", (F.col("p_partkey") % 100).alias("k"))
    return s.join(p, "k").groupBy("s_suppkey").agg(F.min("p_partkey").alias("p_partkey"))


@query("jn19_claim_of_experiment", """
SELECT o_orderkey, min(l_partkey) AS l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND lower(l_linestatus) = lower(CASE WHEN o_orderstatus = 'P' THEN 'o' ELSE o_orderstatus END) AND l_linenumber = 1 GROUP BY 1""")
def jn19(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lower(F.when(F.col("o_orderstatus") == "P", "o").otherwise(F.col("o_orderstatus"))).alias("metric"))
    lines = table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.lower("l_linestatus").alias("metric"), "l_partkey")
    return o.join(lines, ["l_orderkey", "metric"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("l_partkey"))


@query("jn20_evidence_of_assessments", """
WITH a AS (SELECT conv_id, unnest([turn, turn + 1]) AS evidence FROM conversations WHERE role = 'user') SELECT DISTINCT a.conv_id, a.evidence, c.role FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.evidence""")
def jn20(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'user'").select("conv_id", F.explode(F.array("turn", F.col("turn") + 1)).alias("evidence"))
    return a.join(c.select("conv_id", F.col("turn").alias("evidence"), "role"), ["conv_id", "evidence"]).distinct()


@query("so02_gaps", """
WITH c AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS xs FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sort(list_filter(range(1, list_max(xs)::BIGINT + 1), lambda x: NOT list_contains(xs, x)))::VARCHAR AS gaps FROM c""")
def so02(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("xs"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1).cast("long"), F.array_max("xs")), "xs"))
    return c.select("l_orderkey", F.concat(F.lit("["), F.array_join(gaps.cast("array<string>"), ", "), F.lit("]")).alias("gaps"))


@query("so07_missing_inputs", """
WITH r AS (SELECT conv_id, list_distinct(list(role)) AS roles FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(roles, x))), ',') AS missing FROM r""")
def so07(spark, sf):
    r = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return r.select("conv_id", F.array_join(F.array_except(F.array(*[F.lit(x) for x in ("assistant", "system", "user")]), "roles"), ",").alias("missing"))


@query("st05_prefix_limits", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def st05(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("st10_sorted_sections", "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag || l_linenumber) AS codes FROM lineitem GROUP BY 1")
def st10(spark, sf):
    code = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(code)), ",").alias("codes"))


@query("sc06_dehyphenated", "SELECT p_partkey, p_brand || 'experiment x-' || p_size AS text FROM part")
def sc06(spark, sf):
    raw = F.concat("p_brand", F.lit("experi-\n  ment x-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.dehyphenated(raw).alias("text"))


@query("sc07_closed_brackets", "SELECT p_partkey, '[' || p_size || '0] [' || p_size || '] [1-' || p_size || '] [1, ' || p_size || ']' AS text FROM part")
def sc07(spark, sf):
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("["), n, F.lit(" 0] [ "), n, F.lit(" ] [1-"), n, F.lit("] [1, "), n, F.lit("]"))
    return table(spark, sf, "part").select("p_partkey", text.closed_brackets(raw).alias("text"))


@query("sc15_secret_names", "SELECT p_partkey, p_partkey % 3 <> 2 AS secret FROM part")
def sc15(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("GITHUB_TOKEN", "api_key", "WORKERS")]), (1 + F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.secret_name(name).alias("secret"))


@query("sc25_index_ids", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE '2-s2.0-' || (85000000000 + p_partkey) END AS eid FROM part")
def sc25(spark, sf):
    n = (F.lit(85_000_000_000) + F.col("p_partkey")).cast("string")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("https://x.org/record?eid=2-s2.0-"), n, F.lit("&o=r"))).when(k == 1, F.concat(F.lit("2-s2.0-"), n)).when(k == 2, n).otherwise("none")
    return table(spark, sf, "part").select("p_partkey", identifiers.index_id(raw).alias("eid"))


@query("sc26_preprint_dois", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '10.48550/arXiv.' || (1000 + p_size) || '.' || (10000 + p_partkey) END AS doi FROM part")
def sc26(spark, sf):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://arxiv.org/abs/").otherwise("https://x.org/"), (1000 + F.col("p_size")).cast("string"), F.lit("."), (10_000 + F.col("p_partkey")).cast("string"))
    return table(spark, sf, "part").select("p_partkey", identifiers.preprint_doi(raw).alias("doi"))


@query("sc31_context", "SELECT item_id, trim(regexp_replace(substr(text, 11, 40), '\\s+', ' ', 'g')) AS context FROM benchmark")
def sc31(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", identifiers.context(F.col("text"), F.lit(20), F.lit(40), 10).alias("context"))


@query("sc32_location", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""")
def sc32(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("h"))
    return c.select("conv_id", "turn", text.location("conv_id", "turn", F.col("h")).alias("heading"))


@query("dm03_on_conflict_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def dm03(spark, sf):
    """Only some columns of a row that is there are replaced."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("NEW").alias("s"))
    return o.join(new, "o_orderkey", "left").select("o_orderkey", F.coalesce("s", "o_orderstatus").alias("o_orderstatus"), "o_custkey")


@query("dm07_append_versions", """
WITH v AS (SELECT source, sha256(text) AS content_hash, min(doc_id) AS d FROM documents WHERE doc_id < 500 GROUP BY ALL), n AS (SELECT source, count(*) AS top FROM v GROUP BY 1),
f AS (SELECT DISTINCT source, sha256(text) AS content_hash FROM documents WHERE doc_id >= 500 AND NOT EXISTS (SELECT 1 FROM v WHERE v.source = documents.source AND v.content_hash = sha256(documents.text)))
SELECT source, content_hash, row_number() OVER (PARTITION BY source ORDER BY d)::INTEGER AS version FROM v UNION ALL SELECT f.source, f.content_hash, (coalesce(top, 0) + row_number() OVER (PARTITION BY f.source ORDER BY f.content_hash))::INTEGER FROM f LEFT JOIN n USING (source)""")
def dm07b(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    first = d.filter("doc_id < 500").groupBy("source", "content_hash").agg(F.min("doc_id").alias("d"))
    existing = first.select("source", "content_hash", F.row_number().over(Window.partitionBy("source").orderBy("d")).alias("version"))
    return state.append_versions(existing, d.filter("doc_id >= 500").select("source", "content_hash").distinct(), "source")
