"""Queries of artifacts, matching, registry records, sets and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import artifacts, fuzzy, identifiers
from quillstone.functions.spread import spread
from quillstone.operators import aggregates, filters, matching, paging, windows
from quillstone.plans.registry import query
from quillstone.plans.tables import table
from quillstone.sources import bibliography, sinks


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col(key) % len(values)).cast("int"))


def _case(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][1 + {key} % {len(values)}]"


URLS = ("https://arxiv.org/abs/1", "https://x.org/requirements.txt", "https://hub.docker.com/r/a", "https://x.org/run.py", "https://x.org/conf/a.yaml", "https://x.org/w.ckpt", "https://github.com/a/b", "https://huggingface.co/datasets/q", "https://huggingface.co/m", "https://x.org/z")
URL_TYPES = (None, "DEPENDENCY", "CONTAINER", "EXECUTION_SCRIPT", "CONFIG", "CHECKPOINT", "CODE", "DATASET", "MODEL", "SUPPLEMENTARY")


@query("sc71_url_type", f"SELECT p_partkey, {_case(URL_TYPES, 'p_partkey')} AS artifact_type FROM part")
def sc71(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", artifacts.url_type(_pick(URLS, "p_partkey"), F.lit("see the supplementary files")).alias("artifact_type"))


PATHS = ("src/train_model.py", "eval/run_eval.py", "requirements.txt", "Dockerfile", "Makefile", "weights/best.pth", "configs/base.yaml", "README.md", "models/net.py", "tools/predict.ipynb", "lib/tokenize.rs", "bin/go.sh")
KINDS = ("PYTHON", "PYTHON", "DEPENDENCY", "CONTAINER", "MAKEFILE", "CHECKPOINT", "CONFIG", "DOCUMENTATION", "PYTHON", "NOTEBOOK", "RUST", "SHELL")
ROLES = ("TRAINING", "EVALUATION", "DEPENDENCY", "CONFIGURATION", "EXECUTION_SCRIPT", "CHECKPOINT", "CONFIGURATION", "DOCUMENTATION", "MODEL_DEFINITION", "INFERENCE", "PREPROCESSING", "UNKNOWN")


@query("sc73_file_kind", f"SELECT p_partkey, {_case(KINDS, 'p_partkey')} AS file_type, {_case(ROLES, 'p_partkey')} AS role FROM part")
def sc73(spark, sf):
    return table(spark, sf, "part").select("p_partkey", artifacts.file_kind(_pick(PATHS, "p_partkey")).alias("k")).select("p_partkey", "k.*")


HEADINGS = ("1 Introduction", "2. Related Work", "III. METHODS", "Experimental Setup", "4.2 Results and Analysis", "Conclusions", "References", "Appendix A", "Something else", "Abstract")
SECTION_TYPES = ("INTRODUCTION", "RELATED_WORK", "METHODS", "EXPERIMENTAL_SETUP", "RESULTS", "CONCLUSION", "REFERENCES", "APPENDIX", "OTHER", "ABSTRACT")


@query("sc69_section_type", f"SELECT p_partkey, {_case(SECTION_TYPES, 'p_partkey')} AS section_type FROM part")
def sc69(spark, sf):
    return table(spark, sf, "part").select("p_partkey", artifacts.section_type(_pick(HEADINGS, "p_partkey")).alias("section_type"))


@query("sc74_expected_roles", "SELECT p_partkey, (4 + (p_size > 10)::INTEGER + (p_size % 2 = 0)::INTEGER)::INTEGER AS n_roles, (CASE WHEN p_size > 10 THEN 0 ELSE 1 END + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END)::INTEGER AS n_missing FROM part")
def sc74(spark, sf):
    """SO08 as well: expected roles that are not there."""
    roles = artifacts.expected_roles(F.when(F.col("p_size") > 10, "m"), F.when(F.col("p_size") % 2 == 0, "d").otherwise(""))
    everything = artifacts.expected_roles(F.lit("m"), F.lit("d"))
    return table(spark, sf, "part").select("p_partkey", F.size(roles).alias("n_roles"), F.size(F.array_except(everything, roles)).alias("n_missing"))


@query("sc78_plan_status", """
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 48) > 0 THEN 'BLOCKED' WHEN count(*) FILTER (WHERE l_returnflag = 'N') = 0 THEN 'UNKNOWN' WHEN count(*) FILTER (WHERE l_discount = 0) > 0 OR count(*) FILTER (WHERE l_tax = 0) > 0 THEN 'PARTIALLY_READY' ELSE 'READY_FOR_EXECUTION' END AS status FROM lineitem GROUP BY 1""")
def sc78(spark, sf):
    n = lambda c: F.count_if(c)
    c = F.col
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(artifacts.plan_status(n(c("l_quantity") > 48), n(c("l_discount") == 0), n(c("l_tax") == 0), n(c("l_returnflag") == "N")).alias("status"))


@query("ag33_file_readiness", """
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') = 0 THEN 'MISSING' WHEN count(*) FILTER (WHERE l_quantity > 40) > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0 THEN 'COMPLETE' WHEN count(*) FILTER (WHERE l_quantity > 40) > 0 THEN 'PARTIAL' WHEN count(*) FILTER (WHERE l_quantity > 20) > 0 THEN 'LIMITED' ELSE 'UNKNOWN' END AS readiness FROM lineitem GROUP BY 1""")
def ag33(spark, sf):
    c, n = F.col, F.count_if
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(artifacts.file_readiness(n(c("l_quantity") > 40), n(c("l_quantity") > 20), n(c("l_returnflag") == "R"), n(c("l_linestatus") == "O") > 0).alias("readiness"))


@query("ag26_availability_counts", "SELECT p_brand, count(*) FILTER (WHERE p_size > 30)::BIGINT AS available, count(*) FILTER (WHERE p_size <= 10)::BIGINT AS missing, count(*)::BIGINT AS total FROM part GROUP BY 1")
def ag26(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 30).alias("available"), F.count_if(F.col("p_size") <= 10).alias("missing"), F.count("*").alias("total"))


@query("ag30_dependency_conflicts", """
WITH d AS (SELECT DISTINCT p_name, p_brand, p_type FROM part) SELECT p_name, count(DISTINCT p_brand)::BIGINT AS versions, count(*)::BIGINT AS n_rows FROM d GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def ag30(spark, sf):
    d = table(spark, sf, "part").select("p_name", "p_brand", "p_type").distinct()
    return d.groupBy("p_name").agg(F.count_distinct("p_brand").alias("versions"), F.count("*").alias("n_rows")).filter("versions > 1")


@query("ag14_blind_spots", """
SELECT s_suppkey, CASE WHEN s_acctbal < 2000 AND s_nationkey % 3 = 0 THEN 'LOW_RECENCY,BROKEN_IDENTIFIERS' WHEN s_acctbal < 2000 THEN 'LOW_RECENCY' WHEN s_nationkey % 3 = 0 THEN 'BROKEN_IDENTIFIERS' ELSE 'SOUND' END AS spots,
  CASE WHEN s_nationkey % 3 = 0 THEN 'C' WHEN s_acctbal >= 9000 THEN 'A' ELSE 'B' END AS executive_grade FROM supplier""")
def ag14(spark, sf):
    """AG16 as well."""
    invalid = F.when(F.col("s_nationkey") % 3 == 0, 1).otherwise(0)
    spots = aggregates.blind_spots(F.col("s_acctbal") / 100, invalid, F.lit(0.9))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(spots, ",").alias("spots"), aggregates.executive_grade(invalid, F.lit(0), F.col("s_acctbal") / 100).alias("executive_grade"))


@query("ag19_identifier_coverage", """
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE p_partkey % 5 < 3)::BIGINT AS with_doi, round(100.0::DOUBLE * count(*) FILTER (WHERE p_partkey % 5 < 3) / count(*), 2) AS pct FROM part""")
def ag19(spark, sf):
    """AG20 as well."""
    raw = F.when(F.col("p_partkey") % 5 < 3, F.concat(F.lit("doi:10.1234/"), F.col("p_partkey").cast("string"))).otherwise("none")
    d = table(spark, sf, "part").select(identifiers.doi_extract(raw).alias("doi"))
    return d.agg(F.count("*").alias("total"), F.count("doi").alias("with_doi"), F.round(100.0 * F.count("doi") / F.count("*"), 2).alias("pct"))


@query("jn05_first_context", """
WITH m AS (SELECT conv_id, turn, unnest([1 + turn % 3, 1 + (turn + 1) % 3]) AS number, text FROM conversations), f AS (SELECT conv_id, number, arg_min(text, turn) AS context FROM m GROUP BY ALL)
SELECT c.conv_id, r.n AS reference_no, f.context FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT unnest([1, 2, 3, 4])::BIGINT AS n) r LEFT JOIN f ON f.conv_id = c.conv_id AND f.number = r.n""")
def jn05(spark, sf):
    c = table(spark, sf, "conversations")
    refs = c.select("conv_id").distinct().withColumn("reference_no", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3, 4)])))
    markers = c.select("conv_id", F.array(1 + F.col("turn") % 3, 1 + (F.col("turn") + 1) % 3).alias("keys"), F.col("turn").alias("position"), F.col("text").alias("context"))
    return matching.first_context(refs, markers, "conv_id")


@query("jn06_linked_markers", """
SELECT conv_id, turn, len(list_filter([turn % 4, 9], lambda x: x NOT IN (0, 1, 2)))::INTEGER AS n_missing FROM conversations""")
def jn06(spark, sf):
    c = table(spark, sf, "conversations")
    numbers = c.select("conv_id").distinct().withColumn("number", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 1, 2)])))
    m = c.select("conv_id", "turn", F.array(F.col("turn") % 4, F.lit(9).cast("long")).alias("keys"))
    return matching.linked_markers(m, numbers, "conv_id").select("conv_id", "turn", F.size("missing_keys").alias("n_missing"))


@query("jn08_recovery", """
WITH c AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS ordinal, round(l_quantity / 50, 2) AS composite, round(l_discount * 10, 2) AS title_similarity, CASE WHEN l_returnflag = 'R' THEN '' ELSE '10.1/' || l_partkey END AS doi, CASE WHEN l_linestatus = 'O' THEN 'scopus' ELSE 'openalex' END AS provider, l_suppkey FROM lineitem),
u AS (SELECT *, doi <> '' AS has, composite + CASE provider WHEN 'scopus' THEN 0.05::DOUBLE ELSE 0.0 END AS rank FROM c WHERE doi <> '' OR (title_similarity >= 0.9 AND composite >= 0.65))
SELECT l_orderkey, doi, provider, composite FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY has DESC, rank DESC, ordinal, provider DESC, doi DESC) AS k FROM u) WHERE k = 1""")
def jn08(spark, sf):
    c = F.col
    cand = table(spark, sf, "lineitem").select(
        "l_orderkey", (c("l_partkey") * 10 + c("l_linenumber")).alias("ordinal"), F.round(c("l_quantity") / 50, 2).alias("composite"), F.round(c("l_discount") * 10, 2).alias("title_similarity"),
        F.when(c("l_returnflag") == "R", "").otherwise(F.concat(F.lit("10.1/"), c("l_partkey").cast("string"))).alias("doi"), F.when(c("l_linestatus") == "O", "scopus").otherwise("openalex").alias("provider"),
    )
    return matching.recover(cand, "l_orderkey").select("l_orderkey", "doi", "provider", "composite")


@query("jn13_relevance", """
WITH f AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 5))) AS t FROM benchmark), e AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 5))) AS t FROM conversations)
SELECT conv_id * 1000 + turn AS experiment, item_id, count(*)::BIGINT AS shared FROM f JOIN e USING (t) GROUP BY ALL HAVING count(*) >= 2""")
def jn13(spark, sf):
    from quillstone.functions.text import terms

    files = table(spark, sf, "benchmark").select("item_id", terms(F.col("text"), least=5).alias("ft"))
    exps = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("experiment"), terms(F.col("text"), least=5).alias("wt"))
    return matching.relevance(files, exps, "item_id", "experiment", "ft", "wt").filter("shared >= 2")


@query("jn16_scoped_environment", """
WITH s AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus = 'P' AS g FROM orders)
SELECT c_custkey AS o_custkey, coalesce((SELECT min(id) FROM s WHERE NOT g AND s.o_custkey = c.c_custkey), (SELECT min(id) FROM s WHERE g)) AS spec_id FROM customer c""")
def jn16(spark, sf):
    specs = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("spec_id"), (F.col("o_orderstatus") == "P").alias("is_global"))
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return matching.scoped(specs, wanted, "o_custkey", "spec_id", "is_global")


@query("jn24_claim_rollup", """
SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus)))::VARCHAR AS statuses, count(DISTINCT o_orderkey)::BIGINT AS n FROM orders GROUP BY 1""")
def jn24(spark, sf):
    o = table(spark, sf, "orders")
    r = matching.rolled_up(o, "o_custkey", {"statuses": F.col("o_orderstatus"), "orders": F.col("o_orderkey")})
    return r.select("o_custkey", F.concat(F.lit("["), F.array_join("statuses", ", "), F.lit("]")).alias("statuses"), F.size("orders").cast("long").alias("n"))


@query("jn26_newest_case", "SELECT l_partkey, max(l_orderkey) AS l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1")
def jn26(spark, sf):
    return _newest_cases(spark, sf, table(spark, sf, "part"))


def _newest_cases(spark: SparkSession, sf: str, parts: DataFrame) -> DataFrame:
    cases = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("targets")).withColumn("created", F.col("l_orderkey"))
    return matching.newest_containing(cases, "targets", parts.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "created", "l_orderkey")


@query("wn11_step_order", """
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, lower(p_name), p_partkey)::INTEGER AS step FROM part""")
def wn11(spark, sf):
    phase = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"SMALL": 0, "MEDIUM": 1, "LARGE": 2}.items() for x in kv]), F.col("p_type")), F.lit(3))
    w = Window.partitionBy("p_brand").orderBy(phase, F.lower("p_name"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.row_number().over(w).alias("step"))


@query("wn04_latest_snapshot", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def wn04(spark, sf):
    return windows.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "ts", "event_type")


@query("so04_candidate_union", """
SELECT c_custkey AS id, 0::INTEGER AS source_order FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT s_suppkey, 2 FROM supplier""")
def so04(spark, sf):
    parts = [table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))]
    tagged = [p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])


@query("so05_first_source", """
SELECT id, min(source_order)::INTEGER AS source_order FROM (SELECT c_custkey AS id, 0 AS source_order FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT s_suppkey, 2 FROM supplier) GROUP BY 1""")
def so05(spark, sf):
    return so04(spark, sf).groupBy("id").agg(F.min("source_order").alias("source_order"))


@query("f08_review_queue", "SELECT doc_id, CASE WHEN quality = 0 THEN 'AMBIGUOUS' WHEN toxic = 1 THEN 'INVALID_DOI' ELSE 'VALID_CORRECT' END AS final_status FROM labels WHERE quality = 0 OR toxic = 1 OR doc_id % 10 = 0")
def f08(spark, sf):
    status = F.when(F.col("quality") == 0, "AMBIGUOUS").when(F.col("toxic") == 1, "INVALID_DOI").otherwise("VALID_CORRECT")
    return filters.for_review(table(spark, sf, "labels").select("doc_id", status.alias("final_status"), (F.col("doc_id") % 10 == 0).alias("needs_human_review"))).select("doc_id", "final_status")


@query("f11_wrong_identifier", "SELECT event_id FROM events WHERE event_type = 'click' OR (value / 200 < 0.45 AND event_id % 3 = 0)")
def f11(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), (F.col("value") / 200).alias("score"), (F.col("event_id") % 3 == 0).alias("resolves"))
    return e.filter(filters.wrong_identifier("score", "status", "resolves", "click")).select("event_id")


@query("f17_without_secrets", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS kept FROM events")
def f17(spark, sf):
    m = F.create_map(F.lit("user"), F.lit("a"), F.when(F.col("event_id") % 2 == 0, "api_Token").otherwise("note"), F.lit("b"), F.lit("PASSWORD"), F.lit("c"))
    return table(spark, sf, "events").select("event_id", F.size(filters.without_secrets(m)).alias("kept"))


@query("f19_allowed_command", "SELECT p_partkey, p_partkey % 5 = 0 AS allowed FROM part")
def f19(spark, sf):
    commands = _pick(("python a/run.py --x 1", "python ../run.py", "bash a/run.py", "python a/run.py; rm x", "python b.py"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", artifacts.allowed_command(commands, F.array(F.lit("a/run.py"), F.lit("../run.py"))).alias("allowed"))


@query("f22_atomic_result", "SELECT p_partkey, p_partkey % 4 = 0 AS atomic FROM part")
def f22(spark, sf):
    return table(spark, sf, "part").select("p_partkey", artifacts.atomic_result(_pick(("accuracy", "precision / recall", "F1", "F1"), "p_partkey"), _pick(("BERT", "BERT", "several models", "A and B"), "p_partkey")).alias("atomic"))


@query("f23_validation_cap", "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10 THEN 'VALIDATE' ELSE 'SOURCE_UNAVAILABLE' END AS status FROM documents")
def f23(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", F.when(F.row_number().over(w) <= 10, "VALIDATE").otherwise("SOURCE_UNAVAILABLE").alias("status"))


@query("src12_lenient_casts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::INTEGER WHEN 1 THEN 7 END AS number, event_id % 4 IN (0, 2) AS flag FROM events")
def src12(spark, sf):
    number = F.when(F.col("event_id") % 4 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 4 == 1, "7.9").when(F.col("event_id") % 4 == 2, "").otherwise("n/a")
    return table(spark, sf, "events").select("event_id", bibliography.lenient_int(number).alias("number"), bibliography.lenient_bool(_pick(("True", "no", " YES", "2"), "event_id")).alias("flag"))


@query("src26_cache_misses", "SELECT DISTINCT lower(trim(p_name)) AS cache_key FROM part WHERE lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 45)")
def src26(spark, sf):
    p = table(spark, sf, "part")
    cache = p.filter("p_size > 45").select(F.lower(F.trim("p_name")).alias("cache_key")).distinct()
    return bibliography.missing(p.select("p_name"), cache, "p_name")


@query("prj05_precedence", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS title FROM part")
def prj05(spark, sf):
    c = F.col
    return table(spark, sf, "part").select("p_partkey", bibliography.filled(F.when(c("p_size") % 3 == 0, c("p_name")).otherwise("{}"), F.when(c("p_size") % 3 == 1, c("p_brand")).otherwise(" "), c("p_type")).alias("title"))


@query("prj07_registry_record", "SELECT c_custkey, c_name AS title, 'Doe, A; Roe' AS authors, (1990 + c_nationkey)::INTEGER AS year, c_custkey % 7 = 0 AS is_retracted FROM customer")
def prj07(spark, sf):
    payload = F.to_json(F.struct(
        F.lit("10.1/x").alias("DOI"), F.array("c_name").alias("title"), F.array(F.struct(F.lit("Doe").alias("family"), F.lit("A").alias("given")), F.struct(F.lit("Roe").alias("family"), F.lit("").alias("given"))).alias("author"),
        F.struct(F.array(F.array(1990 + F.col("c_nationkey"), F.lit(1))).alias("date-parts")).alias("created"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.struct(F.lit("retraction").alias("type")))).alias("update-to"),
    ))
    return table(spark, sf, "customer").select("c_custkey", bibliography.crossref(payload).alias("r")).select("c_custkey", "r.title", "r.authors", "r.year", "r.is_retracted")


@query("prj11_inverted_abstract", "SELECT item_id, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) AS text FROM benchmark")
def prj11(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("item_id", bibliography.inverted_abstract(F.to_json(F.struct(F.col("m").alias("abstract_inverted_index")))).alias("text"))


@query("prj12_clean_abstract", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' & more <x>' AS text FROM benchmark")
def prj12(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", bibliography.clean_abstract(F.concat(F.lit("<p> "), "text", F.lit("</p>  &amp; more &lt;x&gt;"))).alias("text"))


@query("snk02_summary", "SELECT unnest(['total', 'units', 'high']) AS metric, unnest([count(*), count(DISTINCT l_orderkey), count(*) FILTER (WHERE l_quantity > 40)])::VARCHAR AS value FROM lineitem")
def snk02(spark, sf):
    return sinks.summary(aggregates.kpi_row(table(spark, sf, "lineitem"), "l_orderkey", {"high": F.col("l_quantity") > 40}))


@query("snk08_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20000")
def snk08(spark, sf):
    return sinks.export(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("snk09_stride_sample", """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) SELECT o_orderkey FROM n WHERE n % greatest(1, total // 20) = 0 ORDER BY n LIMIT 20""")
def snk09(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return paging.stride_sample(o, ["o_orderkey"], o.count(), 20)


@query("snk14_backfill", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE 'kept' END AS title FROM customer JOIN nation ON n_nationkey = c_nationkey")
def snk14(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("kept").alias("title"))
    return sinks.backfill(rows, table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("title")), "n_nationkey", "title").select("c_custkey", "title")


@query("sc41_author_similarity")
def sc41(spark, sf):
    """Similarity of neighbouring customers' names, read as authors."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Customer"), (F.col("c_custkey") % 5).cast("string"), F.lit(", A."), F.when(F.col("c_custkey") % 2 == 0, "; Doe, J.").otherwise("")).alias("authors"))
    n = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("authors").alias("other"))
    return spread(c.join(n, "c_custkey")).select("c_custkey", fuzzy.author_similarity(F.col("authors"), F.col("other")).alias("similarity"))


def _verified(spark, sf):
    """Lines of orders as verified references of suppliers' documents."""
    c = F.col
    lines = table(spark, sf, "lineitem").withColumn("no", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")))
    return lines.select(
        F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("source_eid"), c("no").alias("reference_no"), F.concat(F.lit("Title "), c("l_suppkey").cast("string")).alias("source_title"), F.lit(2001).alias("source_year"),
        F.when(c("l_linenumber") != 3, F.year("l_shipdate")).alias("resolved_year"), F.concat(F.lit("work of "), F.year("l_shipdate").cast("string")).alias("raw_reference"), F.when(c("l_returnflag") == "R", "a gap").otherwise("a work").alias("resolved_title"),
        F.when(c("l_linestatus") == "O", F.concat(F.lit("Venue "), c("l_linenumber").cast("string"))).otherwise("n/a").alias("journal"), F.when(c("l_quantity") > 49.5, "VALID_DOI_WRONG_REFERENCE").otherwise("VALID_CORRECT").alias("final_status"),
        F.when((c("l_partkey") % 500 == 0), 404).otherwise(200).alias("http_status"), (c("l_discount") < 0.09).alias("doi_resolves"), (c("l_tax") < 0.07).alias("scopus_linked"),
    )


@query("ag06_document_indicators", """
WITH r AS (SELECT 'S' || l_suppkey AS source_eid, year(l_shipdate) AS y, CASE WHEN l_linestatus = 'O' THEN 'Venue ' || l_linenumber END AS venue, l_quantity > 49.5 AS wrong, l_partkey % 500 = 0 AS invalid, l_discount < 0.09 AS resolves, l_tax < 0.07 AS linked, l_returnflag = 'R' AS gap FROM lineitem),
b AS (SELECT source_eid, count(*)::BIGINT AS total_references, count(*) FILTER (WHERE invalid)::BIGINT AS invalid_dois, count(*) FILTER (WHERE wrong)::BIGINT AS discrepancies, round(100.0::DOUBLE * count(*) FILTER (WHERE resolves) / count(*), 1) AS resolving_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE linked) / count(*), 1) AS linked_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE y >= 1996 AND y <= 2002) / count(*) FILTER (WHERE y <= 2002), 1) AS recency_index, CASE WHEN count(*) FILTER (WHERE gap) > count(*) FILTER (WHERE NOT gap) THEN 'CRITIQUE' ELSE 'BACKGROUND' END AS "primary" FROM r GROUP BY 1)
SELECT *, CASE WHEN invalid_dois >= 3 THEN 'HIGH' WHEN invalid_dois >= 1 OR discrepancies >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN invalid_dois >= 3 THEN 'REQUIRES_REVISION' WHEN invalid_dois >= 1 OR discrepancies >= 2 THEN 'C' WHEN resolving_pct >= 90 AND linked_pct >= 85 THEN CASE WHEN recency_index >= 40 THEN 'A+' ELSE 'A' END WHEN resolving_pct >= 75 OR linked_pct >= 70 THEN 'B' WHEN resolving_pct >= 50 THEN 'C' ELSE 'REQUIRES_REVISION' END AS grade FROM b""")
def ag06(spark, sf):
    from quillstone.operators.indicators import document_indicators

    out = document_indicators(_verified(spark, sf))
    return out.select("source_eid", "total_references", "invalid_dois", "discrepancies", "resolving_pct", "linked_pct", "recency_index", "primary", "risk", "grade")


@query("sc97_canonical_hash", """
SELECT p_partkey, sha256('{"a":{"size":' || p_size || ',"type":"' || p_type || '"},"brand":"' || p_brand || '","note":' || CASE WHEN p_size > 25 THEN '"n"' ELSE 'null' END || ',"tags":["x","' || p_brand || '"]}') AS content_hash FROM part""")
def sc97(spark, sf):
    from quillstone.functions.canonical import content_hash

    c = F.col
    rows = table(spark, sf, "part").select("p_partkey", F.struct(
        F.array(F.lit("x"), c("p_brand")).alias("tags"), F.when(c("p_size") > 25, "n").alias("note"), c("p_brand").alias("brand"), F.lit("now").alias("generated_at"), F.struct(c("p_type").alias("type"), c("p_size").alias("size")).alias("a"),
    ).alias("r"))
    return rows.select("p_partkey", content_hash(c("r"), rows.schema["r"].dataType).alias("content_hash"))


@query("wn08_claim_clusters")
def wn08(spark, sf):
    """Turns of conversations by role, near-equal ones under the first."""
    from quillstone.operators.clustering import claim_clusters

    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("claim"))
    return claim_clusters(c, ["conv_id", "role"], "turn", "claim").select("conv_id", "role", "turn", "cluster")


@query("ag15_audit_indicators", """
WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority AS v, o_orderkey FROM orders), p AS (SELECT o_custkey, v, count(*) AS n, min(o_orderkey) AS seen FROM r GROUP BY ALL),
t AS (SELECT o_custkey, string_agg(v, '|' ORDER BY k) AS top_venues FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) AS k FROM p) WHERE k <= 5 GROUP BY 1)
SELECT o_custkey, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE y BETWEEN 1994 AND 1999) / nullif(count(*) FILTER (WHERE y <= 1999), 0), 1), 0) AS recency_index, round(greatest(0.0::DOUBLE, 1999 - median(y) FILTER (WHERE y <= 1999)), 1) AS median_age, count(*)::BIGINT AS n_references, any_value(top_venues) AS top_venues FROM r JOIN t USING (o_custkey) GROUP BY 1""")
def ag15(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority", "o_orderkey")
    out = aggregates.audit_indicators(o, "o_custkey", "y", "o_orderpriority", "o_orderkey", current_year=1999)
    return out.withColumn("top_venues", F.array_join("top_venues", "|"))


@query("tvf20_container_facts", """
SELECT s_suppkey, 'nvidia/cuda:12.' || s_nationkey || '.1-cudnn8-runtime-ubuntu22.04' AS base_image, '12.' || s_nationkey || '.1' AS cuda_version, '8' AS cudnn_version, 'ubuntu' AS os_name, '22.04' AS os_version, '/app' || s_suppkey AS working_directory, 'TOKEN,MODE' AS variables, 'git,curl,numpy==1.' || s_nationkey AS packages FROM supplier""")
def tvf20(spark, sf):
    from quillstone.functions.environment import container_facts

    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.concat(F.lit("# base\nFROM nvidia/cuda:12."), n, F.lit(".1-cudnn8-runtime-ubuntu22.04 AS b\nENV TOKEN=abc\nARG MODE\nWORKDIR /app"), k, F.lit("\nRUN apt-get update && apt-get install -y git \\\n    curl\nRUN pip install numpy==1."), n, F.lit(" -r requirements.txt\n"))
    r = table(spark, sf, "supplier").select("s_suppkey", container_facts(content).alias("f"))
    return r.select("s_suppkey", "f.base_image", "f.cuda_version", "f.cudnn_version", "f.os_name", "f.os_version", "f.working_directory", F.array_join("f.variables", ",").alias("variables"), F.array_join("f.packages", ",").alias("packages"))


@query("tvf21_documentation_facts", """
SELECT s_suppkey, 'python' AS category, '3.' || s_nationkey AS value, 1::INTEGER AS line_no FROM supplier UNION ALL SELECT s_suppkey, 'cuda', '11.8', 1 FROM supplier UNION ALL SELECT s_suppkey, 'memory', (8 + s_nationkey) || ' GB', 2 FROM supplier""")
def tvf21(spark, sf):
    """Facts of a documentation. Cards that nothing says are needed or used are no fact."""
    from quillstone.functions.environment import documentation_facts

    doc = F.concat(F.lit("Needs Python >= 3."), F.col("s_nationkey").cast("string"), F.lit(" and CUDA 11.8\nWith "), (8 + F.col("s_nationkey")).cast("string"), F.lit(" GB of RAM on 4 x A100 cards\nNothing else"))
    return documentation_facts(table(spark, sf, "supplier").select("s_suppkey", doc.alias("doc")), "s_suppkey", "doc").select("s_suppkey", "category", "value", "line_no")


@query("tvf27_environment_scope", """
SELECT p_name, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'GLOBAL' END AS scope, count(DISTINCT p_type)::BIGINT AS n_experiments FROM part GROUP BY 1""")
def tvf27(spark, sf):
    """Evidence of one experiment is that experiment's; what several share is global."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.when(F.count_distinct("p_type") == 1, F.min("p_type")).otherwise("GLOBAL").alias("scope"), F.count_distinct("p_type").alias("n_experiments"))


@query("tvf28_readme_evidence", """
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(lower(x), 'license')) AS hits FROM documents)
SELECT doc_id, array_to_string(hits[1:2], ' / ') AS evidence FROM l WHERE len(hits) > 0""")
def tvf28(spark, sf):
    hits = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(x).contains("license")), 1, 2)
    return table(spark, sf, "documents").select("doc_id", hits.alias("h")).filter(F.size("h") > 0).select("doc_id", F.array_join("h", " / ").alias("evidence"))


@query("tvf24_evidence_requirements", """
SELECT doc_id, 'TEXT' AS requirement, 'documents' AS origin FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'REVIEW', 'labels' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'QUALITY', 'labels' FROM labels WHERE quality = 0""")
def tvf24(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = lambda df, what, where: df.select("doc_id", F.lit(what).alias("requirement"), F.lit(where).alias("origin"))
    return one(d.filter("n_chars > 3000"), "TEXT", "documents").unionByName(one(lab.filter("toxic = 1"), "REVIEW", "labels")).unionByName(one(lab.filter("quality = 0"), "QUALITY", "labels"))


@query("jn25_batch_fetch", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn25(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(ids, "c_custkey", "left_semi")


@query("dm06_terminal_violations", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0")
def dm06(spark, sf):
    from quillstone.operators import state

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.md5(F.col("o_custkey").cast("string")).alias("content"))
    new = o.withColumn("content", F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("content")))
    return state.terminal_violations(o, new, "o_orderkey", "status", ["F"], "content").select("o_orderkey")


@query("dm14_idempotent_diagnostics", "SELECT event_id FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0)")
def dm14(spark, sf):
    """Diagnostics without a test yet: evaluating again adds nothing."""
    e = table(spark, sf, "events")
    return e.filter("event_type = 'click'").select("event_id").join(e.filter("event_id % 4 = 0").select("event_id"), "event_id", "left_anti")
