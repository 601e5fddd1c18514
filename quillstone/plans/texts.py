"""Queries of identifiers, references, citations, decisions and similarity over synthesised strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import citations, fuzzy, identifiers, ladders, model_json, text
from quillstone.plans.registry import query
from quillstone.plans.tables import table


@query("sc14_redact", r"""
SELECT doc_id, regexp_replace(text, '(?i)\b([A-Z0-9_]*(?:token|secret|password|api_?key)[A-Z0-9_]*)\s*[=:]\s*(?:"[^"]*"|''[^'']*''|[^\s"'']+)', '\1=[REDACTED]', 'g') AS text FROM documents""")
def sc14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"))


@query("sc08_alnum_form", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS form FROM documents")
def sc08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.alnum_form(F.col("text")).alias("form"))


@query("sc11_terms", "SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for'))).len()::INTEGER AS n_terms FROM benchmark")
def sc11(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(text.terms(F.col("text"), ("the", "and", "for"))).alias("n_terms"))


@query("sc13_surname", "SELECT c_custkey, string_split(c_name, '#')[-1] AS surname FROM customer")
def sc13(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.element_at(F.split("c_name", "#"), -1).alias("surname"))


@query("prj01_reference_id", "SELECT l_orderkey, l_partkey, l_linenumber, format('{}_{:04d}', l_orderkey, l_linenumber) AS reference_id FROM lineitem")
def prj01(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.format_string("%s_%04d", F.col("l_orderkey").cast("string"), "l_linenumber").alias("reference_id"))


@query("prj16_stable_id", "SELECT p_partkey, 'PLAN-' || upper(substr(sha256(coalesce(nullif(p_brand, ''), 'none') || ':' || coalesce(nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, ''), 'none')), 1, 16)) AS plan_id FROM part")
def prj16(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.stable_id("PLAN", F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")).alias("plan_id"))


DOIS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'doi:10.' || (1000 + p_size) || '/ABC.' || p_partkey || ').' WHEN 1 THEN 'see https://doi.org/10.' || (1000 + p_size) || '/x(' || p_partkey || ')9; and' WHEN 2 THEN 'DOI: 10.' || (1000 + p_size) || '/y-' || p_partkey || ',' WHEN 3 THEN 'no identifier ' || p_partkey ELSE '10.12/short' END AS raw FROM part"


def _dois(spark, sf):
    c, n, k = F.col("p_partkey") % 5, (F.col("p_size") + 1000).cast("string"), F.col("p_partkey").cast("string")
    raw = (
        F.when(c == 0, F.concat(F.lit("doi:10."), n, F.lit("/ABC."), k, F.lit(").")))
        .when(c == 1, F.concat(F.lit("see https://doi.org/10."), n, F.lit("/x("), k, F.lit(")9; and")))
        .when(c == 2, F.concat(F.lit("DOI: 10."), n, F.lit("/y-"), k, F.lit(",")))
        .when(c == 3, F.concat(F.lit("no identifier "), k))
        .otherwise("10.12/short")
    )
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"))


@query("sc20_doi_extract", rf"""
WITH e AS (SELECT p_partkey, regexp_replace(regexp_extract(raw, '10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'), '[.,;:\s]+$', '') AS d FROM ({DOIS})),
b AS (SELECT p_partkey, CASE WHEN d LIKE '%)' AND length(d) - length(replace(d, ')', '')) > length(d) - length(replace(d, '(', '')) THEN d[:-2] ELSE d END AS d FROM e)
SELECT p_partkey, nullif(d, '') AS doi FROM b""")
def sc20(spark, sf):
    return _dois(spark, sf).select("p_partkey", identifiers.doi_extract(F.col("raw")).alias("doi"))


@query("sc27_canonical_url", r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))
  || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') || regexp_extract(url, '(\?[^#]*)', 1) AS url FROM pages""")
def sc27(spark, sf):
    return table(spark, sf, "pages").select("page_id", identifiers.canonical_url(F.col("url")).alias("url"))


@query("sc24_first_url", "SELECT page_id, url AS raw, rtrim(regexp_extract('see https://doi.org/10.1/x and ' || url || ').', 'and (https?://[^\\s<>\"'']+)', 1), '.,;)') AS url FROM pages")
def sc24(spark, sf):
    raw = F.concat(F.lit("see https://doi.org/10.1/x and "), "url", F.lit(")."))
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("raw"), identifiers.first_url(raw).alias("url"))


@query("sc28_repository", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'github' WHEN s_suppkey % 3 = 1 THEN 'gitlab' END AS platform, CASE WHEN s_suppkey % 3 = 0 THEN 'org' || s_nationkey WHEN s_suppkey % 3 = 1 THEN 'a/b' || s_nationkey END AS owner,
  CASE WHEN s_suppkey % 3 < 2 THEN 'repo' || s_suppkey END AS name FROM supplier""")
def sc28(spark, sf):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    url = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://github.com/org"), n, F.lit("/repo"), k, F.lit(".git?tab=1")))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://gitlab.com/a/b"), n, F.lit("/repo"), k, F.lit("/")))
        .otherwise(F.concat(F.lit("https://example.org/x/"), k))
    )
    return table(spark, sf, "supplier").select("s_suppkey", identifiers.repository(url).alias("r")).select("s_suppkey", "r.platform", "r.owner", "r.name")


@query("sc29_publication_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders")
def sc29(spark, sf):
    raw = F.concat(F.lit("arXiv:1901.00001 and 10.1234/2005.77, published 1850, again "), F.year("o_orderdate").cast("string"), F.lit("."))
    return table(spark, sf, "orders").select("o_orderkey", identifiers.publication_year(raw).alias("year"))


@query("sc30_unroll", """
SELECT l_orderkey, l_partkey, l_linenumber, list_sort(list_distinct(list_concat(CASE WHEN l_quantity::BIGINT < 50 THEN range(l_linenumber::BIGINT, l_linenumber + l_quantity::BIGINT + 1) ELSE [l_linenumber::BIGINT, l_linenumber + l_quantity::BIGINT] END, [l_suppkey])))::VARCHAR AS keys FROM lineitem""")
def sc30(spark, sf):
    a, k = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    raw = F.concat_ws("", a.cast("string"), F.lit(" - "), (a + k).cast("string"), F.lit(", "), F.col("l_suppkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.concat(F.lit("["), F.array_join(identifiers.unroll(raw).cast("array<string>"), ", "), F.lit("]")).alias("keys"))


def _reference(prefix: str = "") -> object:
    c = F.col
    return F.concat(F.lit("Smith J., "), c("p_name"), F.lit(", "), c("p_brand"), F.lit(", "), c("p_size").cast("string"), F.lit(", 3, pp. "), c("p_partkey").cast("string"), F.lit("-"), (c("p_partkey") + 7).cast("string"), F.lit(", ("), (1950 + c("p_size")).cast("string"), F.lit(")"))


@query("prj03_reference_record", """
SELECT p_partkey, (1950 + p_size)::INTEGER AS cited_year, 1::INTEGER AS year_marker_count, '' AS extracted_doi, false AS needs_review FROM part""")
def prj03(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", citations.reference_record(_reference()).alias("r"))
    return r.select("p_partkey", "r.cited_year", "r.year_marker_count", "r.extracted_doi", "r.needs_review")


@query("tvf05_parse", """
SELECT p_partkey, p_name AS cited_title, p_brand AS cited_journal, p_size::VARCHAR AS cited_volume, '3' AS cited_issue, p_partkey || '-' || (p_partkey + 7) AS cited_pages, (1950 + p_size)::INTEGER AS cited_year FROM part""")
def tvf05(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", citations.citation_fields(_reference()).alias("r"))
    return r.select("p_partkey", "r.cited_title", "r.cited_journal", "r.cited_volume", "r.cited_issue", "r.cited_pages", "r.cited_year")


@query("tvf01_split", """
SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS reference_no, 'Smith J., ' || p_name || ', ' || p_brand || ', ' || p_size || ', 3, pp. ' || p_partkey || '-' || (p_partkey + 7) || ', (' || (1950 + p_size) || ')' AS raw_reference FROM part""")
def tvf01(spark, sf):
    refs = table(spark, sf, "part").select("p_brand", "p_partkey", _reference().alias("raw"))
    joined = refs.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "raw"))), lambda x: x["raw"]), "; ").alias("text"))
    return citations.references(joined, "p_brand", "text").select("p_brand", "reference_no", "raw_reference")


BODY = "'As shown [' || l_linenumber || '] and [' || l_linenumber || '-' || (l_linenumber + 2) || '], see (Smith, 2019)' || repeat(' (Lee et al., 2020)', l_orderkey % 4) || '.'"


@query("tvf07_scan", """
SELECT l_orderkey, l_partkey, l_linenumber, 2::BIGINT AS bracketed, (1 + l_orderkey % 4)::BIGINT AS author_year, CASE WHEN l_orderkey % 4 >= 2 THEN 'AUTHOR_YEAR' ELSE 'NUMERIC_BRACKETED' END AS style FROM lineitem""")
def tvf07(spark, sf):
    n = F.col("l_linenumber")
    body = F.concat(F.lit("As shown ["), n.cast("string"), F.lit("] and ["), n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit("], see (Smith, 2019)"), F.repeat(F.lit(" (Lee et al., 2020)"), (F.col("l_orderkey") % 4).cast("int")), F.lit("."))
    counted = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", citations.marker_counts(body).alias("c"))
    return counted.select("l_orderkey", "l_partkey", "l_linenumber", F.col("c.NUMERIC_BRACKETED").alias("bracketed"), F.col("c.AUTHOR_YEAR").alias("author_year"), citations.dominant_style(F.col("c")).alias("style"))


@query("tvf09_sections", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
n AS (SELECT *, sum((length(line) < 40)::INTEGER) OVER (PARTITION BY doc_id ORDER BY no)::BIGINT AS section, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
SELECT doc_id, section, arg_min(line, no) AS title, count(*)::BIGINT AS n_lines, min(start)::BIGINT AS start_offset, max(start + length(line))::BIGINT AS end_offset FROM n GROUP BY ALL""")
def tvf09(spark, sf):
    return citations.sections(table(spark, sf, "documents"), "doc_id", "text", F.length("line") < 40)


@query("tvf11_chunks")
def tvf11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", citations.chunks(F.split("text", "\n"), 2000, 300).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query("tvf08_segment", """
SELECT doc_id, true AS found FROM documents""")
def tvf08(spark, sf):
    whole = F.concat(F.repeat(F.lit("body line\n"), 20), F.coalesce("text", F.lit("")), F.lit("\nReferences\n"), F.repeat(F.lit("[1] A work of some length.\n"), 3))
    d = table(spark, sf, "documents").select("doc_id", citations.manuscript_parts(whole).alias("p"))
    return d.select("doc_id", (F.col("p.bibliography").startswith("[1] A work") & F.col("p.body").startswith("body line")).alias("found"))


@query("tvf16_url_candidates", "SELECT page_id, url, 1::BIGINT AS n FROM pages")
def tvf16(spark, sf):
    broken = F.concat(F.lit("code at "), F.regexp_replace("url", "^(https?://[^/]+/)", "$1\n "), F.lit(" here"))
    mended = F.regexp_replace(broken, r"/\s*\n\s*", "/")
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(mended, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))).alias("url"))
    return p.groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query("tvf19_requirements", """
SELECT s_suppkey, 'numpy' AS name, '==1.' || s_nationkey AS version_constraint, 2::INTEGER AS line_no FROM supplier UNION ALL SELECT s_suppkey, 'pkg' || s_suppkey, '>=2,<3', 3 FROM supplier UNION ALL SELECT s_suppkey, 'plain', '', 6 FROM supplier""")
def tvf19(spark, sf):
    content = F.concat(F.lit("# pinned\nnumpy==1."), F.col("s_nationkey").cast("string"), F.lit("  # why\nPkg"), F.col("s_suppkey").cast("string"), F.lit("[extra]>=2,<3\n-r other.txt\nhttps://x.org/a.whl\nplain\n"))
    s = table(spark, sf, "supplier").select("s_suppkey", content.alias("content"))
    return citations.requirements(s, "s_suppkey", "content").select("s_suppkey", "name", "version_constraint", "line_no")


@query("tvf22_parameters", """
SELECT s_suppkey, 'learning_rate' AS name, '0.0' || s_nationkey AS value FROM supplier UNION ALL SELECT s_suppkey, 'batch_size', (s_nationkey + 8)::VARCHAR FROM supplier UNION ALL SELECT s_suppkey, 'optimizer', 'Adam' FROM supplier""")
def tvf22(spark, sf):
    body = F.concat(F.lit("We use a learning rate of 0.0"), F.col("s_nationkey").cast("string"), F.lit(" here.\nThe batch size: "), (F.col("s_nationkey") + 8).cast("string"), F.lit(" and optimizer = Adam"))
    return citations.parameters(table(spark, sf, "supplier").select("s_suppkey", body.alias("body")), "s_suppkey", "body").select("s_suppkey", "name", "value")


@query("tvf23_metric", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'NOT_FOUND' ELSE 'UNAVAILABLE' END AS status, CASE WHEN event_id % 4 = 0 THEN (props->>'$.k')::DOUBLE / 100 END AS value FROM events""")
def tvf23(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    value = F.concat(F.lit("accuracy="), (F.col("k").cast("double") / 100).cast("string"))
    kind = F.col("event_id") % 4
    out = F.when(kind == 0, value).when(kind == 1, F.concat(value, F.lit("\n"), value)).when(kind == 2, F.lit("loss=0.5")).otherwise(value)
    status = F.when(kind == 3, "FAILED").otherwise("COMPLETED")
    r = e.select("event_id", citations.observed(citations.metric_candidates(out, "accuracy"), status, F.lit(True)).alias("r"))
    return r.select("event_id", "r.status", "r.value")


@query("sc46_logistic", """
WITH f AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 50 AS t, l_discount * 10 AS a, l_tax * 10 AS j, (l_returnflag = 'N')::INTEGER AS y, (l_linestatus = 'O')::INTEGER AS v, (l_linenumber > 3)::INTEGER AS p, (l_suppkey % 2)::INTEGER AS r FROM lineitem),
z AS (SELECT *, least(20, greatest(-20, -4.5::DOUBLE + 3.5::DOUBLE * t + 2.2::DOUBLE * a + 1.2::DOUBLE * j + 1.0::DOUBLE * y + 0.6::DOUBLE * v + 0.6::DOUBLE * p + 2.0::DOUBLE * (t + a) / 2 + 1.5::DOUBLE * r)) AS z FROM f)
SELECT l_orderkey, l_partkey, l_linenumber, round(1 / (1 + exp(-z)), 4) AS probability,
  CASE WHEN r = 1 AND t < 0.35 THEN 'WRONG_REFERENCE' WHEN round(1 / (1 + exp(-z)), 4) >= 0.75 THEN 'CORRECT' WHEN round(1 / (1 + exp(-z)), 4) >= 0.45 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS label FROM z""")
def sc46(spark, sf):
    c = F.col
    t, a, j = c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 10
    no = F.lit(False)
    resolves = (c("l_suppkey") % 2) == 1
    features = {
        "title_similarity": t, "author_similarity": a, "journal_similarity": j, "year_match": c("l_returnflag") == "N", "volume_match": c("l_linestatus") == "O", "pages_match": c("l_linenumber") > 3,
        "composite_score": (t + a) / 2, "doi_resolves": resolves, "is_redirect": no, "is_restricted": no, "is_retracted": no,
    }
    p = fuzzy.probability({k: v.cast("double") if v is t or v is a or v is j else v.cast("int") if k != "composite_score" else v for k, v in features.items()})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", p.alias("probability"), fuzzy.predicted_label(p, t, resolves, F.lit(200)).alias("label"))


LADDER = """
SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS c, ((event_id * 7) % 101) / 100.0::DOUBLE AS t, ((event_id * 3) % 101) / 100.0::DOUBLE AS a, event_id % 2 = 0 AS y, event_id % 11 <> 0 AS ex, event_id % 5 <> 0 AS rs,
  [200, 200, 301, 403, 404, 500][1 + event_id % 6] AS h, event_id % 3 AS rd, event_id % 17 = 0 AS rt FROM events"""


def _ladder(spark, sf):
    i = F.col("event_id")
    part = lambda k: ((i * k) % 101) / F.lit(100.0)
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 200, 301, 403, 404, 500)]), (1 + i % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", part(1).alias("c"), part(7).alias("t"), part(3).alias("a"), (i % 2 == 0).alias("y"), (i % 11 != 0).alias("ex"), (i % 5 != 0).alias("rs"), status.alias("h"), (i % 3).alias("rd"), (i % 17 == 0).alias("rt"))


@query("sc60_decision", f"""
SELECT event_id, CASE WHEN NOT ex OR h = 404 THEN 'INVALID_DOI' WHEN rt AND c >= 0.85 THEN 'RETRACTED_REFERENCE' WHEN rs AND (c < 0.45 OR t < 0.35) THEN 'VALID_DOI_WRONG_REFERENCE' WHEN h = 403 THEN 'ACCESS_RESTRICTED' WHEN NOT rs AND h >= 400 THEN 'BROKEN_URL'
    WHEN c >= 0.85 OR (t >= 0.95 AND a >= 0.55 AND y AND c >= 0.75) THEN CASE WHEN rd > 0 THEN 'VALID_REDIRECT_CORRECT' ELSE 'VALID_CORRECT' END WHEN c >= 0.65 THEN 'METADATA_MISMATCH' ELSE 'AMBIGUOUS' END AS final_status,
  CASE WHEN NOT ex OR h = 404 THEN 'HIGH' WHEN rt AND c >= 0.85 THEN 'HIGH' WHEN rs AND (c < 0.45 OR t < 0.35) THEN CASE WHEN t < 0.25 THEN 'HIGH' ELSE 'MEDIUM' END WHEN h = 403 THEN CASE WHEN c >= 0.85 THEN 'HIGH' WHEN c >= 0.65 THEN 'MEDIUM' ELSE 'UNCERTAIN' END WHEN NOT rs AND h >= 400 THEN 'MEDIUM'
    WHEN c >= 0.85 OR (t >= 0.95 AND a >= 0.55 AND y AND c >= 0.75) THEN 'HIGH' WHEN c >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM ({LADDER})""")
def sc60(spark, sf):
    c = F.col
    d = _ladder(spark, sf).select("event_id", ladders.with_identifier(c("c"), c("t"), c("a"), c("y"), c("ex"), c("rs"), c("h"), c("rd"), c("rt")).alias("d"))
    return d.select("event_id", "d.final_status", "d.confidence")


@query("sc61_recovered", f"""
SELECT event_id, CASE WHEN rd = 0 THEN 'DOI_MISSING' WHEN (c >= 0.85 AND t >= 0.8) OR (t >= 0.98 AND a >= 0.3 AND y AND c >= 0.6) THEN 'DOI_RECOVERED' WHEN c >= 0.65 THEN 'DOI_RECOVERY_UNCERTAIN' ELSE 'DOI_MISSING' END AS final_status FROM ({LADDER})""")
def sc61(spark, sf):
    c = F.col
    doi = F.when(c("rd") != 0, "10.1/x").otherwise("")
    return _ladder(spark, sf).select("event_id", ladders.recovered_identifier(c("c"), c("t"), c("a"), c("y"), doi)["final_status"].alias("final_status"))


@query("sc63_ground_truth", f"""
SELECT event_id, CASE WHEN rd > 0 AND h = 403 THEN 'ACCESS_RESTRICTED' WHEN rd > 0 AND h = 404 THEN 'BROKEN_URL' WHEN rd > 0 THEN 'VALID_CORRECT' WHEN rs AND t >= 0.88 AND y THEN 'DOI_RECOVERED' WHEN rs THEN 'SCOPUS_LINKED_NO_DOI' WHEN t >= 0.85 AND y THEN 'DOI_RECOVERED' ELSE 'SCOPUS_UNLINKED' END AS final_status FROM ({LADDER})""")
def sc63(spark, sf):
    c = F.col
    return _ladder(spark, sf).select("event_id", ladders.ground_truth_status(F.when(c("rd") > 0, "10.1/x"), c("h"), c("rs"), c("t"), c("y")).alias("final_status"))


@query("sc66_http", f"""
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'TIMEOUT' WHEN event_id % 19 = 0 THEN 'NETWORK_ERROR' WHEN h = 200 AND rd > 0 THEN 'REDIRECT_REACHABLE' WHEN h = 200 THEN 'REACHABLE' WHEN h = 301 THEN 'REDIRECTING' WHEN h = 403 THEN 'ACCESS_RESTRICTED' WHEN h = 404 THEN 'BROKEN_NOT_FOUND' ELSE 'SERVER_ERROR' END AS category FROM ({LADDER})""")
def sc66(spark, sf):
    error = F.when(F.col("event_id") % 13 == 0, "read timeout").when(F.col("event_id") % 19 == 0, "refused")
    return _ladder(spark, sf).select("event_id", ladders.http_category(F.col("h"), F.col("rd"), error).alias("category"))


@query("sc68_intent", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'METHODOLOGY' WHEN p_partkey % 5 = 1 THEN 'CRITIQUE' WHEN p_partkey % 5 = 2 THEN 'COMPARISON' WHEN p_partkey % 5 = 3 THEN 'CORROBORATION' ELSE 'BACKGROUND' END AS intent FROM part""")
def sc68(spark, sf):
    words = F.array(*[F.lit(s) for s in ("We ADOPT it", "However it is slow", "versus others", "agrees with us", "seen before")])
    return table(spark, sf, "part").select("p_partkey", ladders.intent(F.element_at(words, (1 + F.col("p_partkey") % 5).cast("int"))).alias("intent"))


@query("sc75_command_safety", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'UNSAFE_TO_EXECUTE' WHEN 1 THEN 'SAFE_TO_PLAN' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'REQUIRES_REVIEW' ELSE 'UNSAFE_TO_EXECUTE' END AS safety, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END::INTEGER AS n_reasons FROM part""")
def sc75(spark, sf):
    commands = F.array(*[F.lit(s) for s in ("sudo rm -r x", "python train.py --lr 1", 'python "train.py', "bash run.sh", "python a.py && b")])
    r = table(spark, sf, "part").select("p_partkey", ladders.command_safety(F.element_at(commands, (1 + F.col("p_partkey") % 5).cast("int"))).alias("r"))
    return r.select("p_partkey", "r.safety", F.size("r.reasons").alias("n_reasons"))


@query("sc83_compare", """
WITH c AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, p_retailprice * l_quantity AS published, l_extendedprice AS observed, l_linenumber % 2 = 0 AS full_context, CASE WHEN l_linenumber > 1 THEN 5000.0::DOUBLE END AS tolerance, CASE WHEN l_suppkey % 2 = 0 THEN 'stated' ELSE '' END AS basis FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, round(abs(observed - published), 2) AS difference, CASE WHEN full_context AND (observed = published OR (tolerance IS NOT NULL AND basis <> '' AND abs(observed - published) <= tolerance)) THEN 'VERIFIED' WHEN full_context AND tolerance IS NOT NULL AND basis <> '' THEN 'NOT_REPRODUCED' ELSE 'INCONCLUSIVE' END AS status FROM c""")
def sc83(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    tolerance, basis = F.when(F.col("l_linenumber") > 1, F.lit(5000.0)), F.when(F.col("l_suppkey") % 2 == 0, "stated").otherwise("")
    r = lines.join(p, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", ladders.compared(F.col("p_retailprice") * F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber") % 2 == 0, tolerance, basis).alias("r"))
    return r.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.round("r.absolute_difference", 2).alias("difference"), "r.status")


@query("sc82_agreement", """
SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = 0 THEN 'UNKNOWN' WHEN a.n_regionkey = b.n_regionkey THEN 'MATCH' ELSE 'MISMATCH' END AS agreement FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25""")
def sc82(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    b = n.select(((F.col("n_nationkey") + 20) % 25).alias("a"), F.col("n_nationkey").alias("b"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("rb"))
    a = n.select(F.col("n_nationkey").alias("a"), F.when(F.col("n_regionkey") == 0, " ").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("ra"))
    return a.join(b, "a").select("a", "b", ladders.agreement(F.col("ra"), F.col("rb")).alias("agreement"))


@query("sc86_diagnostic", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN value > 50 THEN 'SUPPORTING' ELSE 'CONTRADICTING' END WHEN 1 THEN CASE WHEN value < 50 THEN 'SUPPORTING' ELSE 'CONTRADICTING' END ELSE 'INCONCLUSIVE' END AS outcome FROM events""")
def sc86(spark, sf):
    rule = F.element_at(F.array(F.lit("METRIC_INCREASES"), F.lit("METRIC_DECREASES"), F.lit("as the text says")), (1 + F.col("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", ladders.diagnostic_outcome(rule, F.col("value"), F.lit(50.0)).alias("outcome"))


@query("f20_first_failure", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NOT_APPROVED' WHEN o_totalprice > 300000 THEN 'OVER_BUDGET' WHEN o_custkey % 7 = 0 THEN 'EXPIRED' END AS code FROM orders""")
def f20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ladders.first_failure((F.col("o_orderstatus") != "P", "NOT_APPROVED"), (F.col("o_totalprice") <= 300000, "OVER_BUDGET"), (F.col("o_custkey") % 7 != 0, "EXPIRED")).alias("code"))


@query("sc40_title_similarity")
def sc40(spark, sf):
    """Similarity of each part's name with the next one's; pairs of equal names are scored once in a batch."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(n, "p_partkey").select("p_partkey", "p_name", "other", fuzzy.title_similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query("sc42_composite", """
SELECT event_id, round((0.4::DOUBLE * t + 0.25::DOUBLE * a + CASE WHEN event_id % 2 = 0 THEN 0.15::DOUBLE * c ELSE 0 END + 0.1::DOUBLE * CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0 END) / (0.65::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE), 3) AS composite FROM ({0})""".replace("{0}", LADDER))
def sc42(spark, sf):
    c = F.col
    year = fuzzy.year_score(F.lit(2020), F.lit(2020) - c("event_id") % 3)
    score = fuzzy.composite(c("t"), c("a"), F.when(c("event_id") % 2 == 0, c("c")), year, F.lit(None).cast("double"))
    return _ladder(spark, sf).select("event_id", F.round(score, 3).alias("composite"))


@query("sc96_tolerant_json", """
SELECT doc_id, lang, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL""")
def sc96(spark, sf):
    """Every text, put into JSON and that into an answer: alone, in a fence, or in prose with more braces behind it."""
    d = table(spark, sf, "documents").filter("text is not null")
    inner = F.to_json(F.struct("doc_id", F.struct("lang", "text").alias("of")))
    answer = F.when(F.col("lang") == "en", F.concat(F.lit("Here it is:\n```json\n"), F.replace(inner, F.lit("`"), F.lit("\\u0060")), F.lit("\n```\nDone."))).when(F.col("lang").isin("fr", "de"), F.concat(F.lit("Voici : "), inner, F.lit(" and {more} of it }"))).otherwise(F.concat(F.lit(" \n"), inner))
    v = d.select(model_json.tolerant_json(answer).alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return v.select(at("$.doc_id", "long").alias("doc_id"), at("$.of.lang", "string").alias("lang"), F.length(at("$.of.text", "string")).cast("long").alias("n_chars"))
