"""Queries of facets, pages, text forms, scores and decision rules over the columns and texts of the tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import artifacts, canonical, citations, fuzzy, text
from quillstone.operators import aggregates, filters, paging, windows
from quillstone.plans.registry import query
from quillstone.plans.tables import table

WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


def _title_form_sql() -> str:
    """The title form in SQL: letters of Latin-1 and Latin Extended-A with a mark become their base and a blank."""
    form = "lower(text)"
    for c in map(chr, range(0xE0, 0x180)):
        base = unicodedata.normalize("NFKD", c)
        if len(base) > 1 and c == c.lower():
            form = f"replace({form}, '{c}', '{base[0]} ')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({form}, '<[^>]+>', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


TITLE_FORM = _title_form_sql()


@query("f02_status_facet", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(filters.member("o_orderstatus", "F, P")).select("o_orderkey", "o_orderstatus")


@query("f03_priority_facet", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def f03(spark, sf):
    return table(spark, sf, "orders").filter(filters.member("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("f06_source_facet", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def f06(spark, sf):
    return filters.faceted(table(spark, sf, "documents"), members={"source": ["src1"]}).select("doc_id", "lang")


@query("f09_document_facets", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%widget%' OR p_brand ILIKE '%widget%') AND p_type IN ('ECONOMY', 'PROMO') AND p_brand IN ('Brand#13', 'Brand#21', 'Brand#34')")
def f09(spark, sf):
    return filters.faceted(table(spark, sf, "part"), " widget ", ["p_name", "p_brand"], {"p_type": "ECONOMY,PROMO", "p_brand": "Brand#13,Brand#21,Brand#34"}).select("p_partkey")


@query("f10_summary_search", "SELECT doc_id FROM documents WHERE text ILIKE '%sch%' OR source ILIKE '%sch%' OR lang ILIKE '%sch%'")
def f10(spark, sf):
    return filters.faceted(table(spark, sf, "documents"), "sch", ["text", "source", "lang"]).select("doc_id")


@query("f12_explorer", "SELECT event_id FROM events WHERE event_type IN ('error', 'click') AND (props ILIKE '%7%' OR event_type ILIKE '%7%')")
def f12(spark, sf):
    return filters.faceted(table(spark, sf, "events"), "7", ["props", "event_type"], {"event_type": "error,click"}).select("event_id")


@query("f14_shape_guards", "SELECT doc_id, length(text) >= 10 AS searchable, len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 5 AS has_words FROM documents WHERE length(trim(coalesce(text, ''))) > 0")
def f14(spark, sf):
    """Texts long enough for a search, and those with words enough to be one."""
    t = F.col("text")
    return table(spark, sf, "documents").filter(F.length(F.trim(F.coalesce(t, F.lit("")))) > 0).select("doc_id", (F.length(t) >= 10).alias("searchable"), (F.regexp_count(t, F.lit("[A-Za-z]{3,}")) >= 5).alias("has_words"))


@query("st01_ordered_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def st01(spark, sf):
    return paging.page(table(spark, sf, "orders"), paging.ordering("o_totalprice", "desc", ["o_totalprice", "o_orderdate"], "o_orderkey", "o_orderkey"), 3, 50).select("o_orderkey", "o_totalprice")


@query("st03_document_page", "SELECT o_custkey, count(*) AS total, sum(o_totalprice) AS price FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 20 OFFSET 20")
def st03(spark, sf):
    df = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.sum("o_totalprice").alias("price"))
    return paging.page(df, paging.ordering("no such column", "desc", ["price"], "total", "o_custkey"), 2, 20)


@query("st07_top_of_group", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def st07(spark, sf):
    df = paging.top_of_group(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_partkey", "l_suppkey", "l_linenumber"], 3)
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("wn02_excerpt", "SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS excerpt FROM conversations")
def wn02(spark, sf):
    return windows.excerpt(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "excerpt")


@query("prj17_sequential_ids", "SELECT conv_id, turn, format('claim_{}', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS claim_id FROM conversations WHERE role = 'assistant'")
def prj17(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("claim_"), n.cast("string")).alias("claim_id"))


@query("sc01_squeezed", r"SELECT item_id, trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g')) AS form FROM benchmark")
def sc01(spark, sf):
    """Texts decomposed and squeezed, shown without their marks."""
    return table(spark, sf, "benchmark").select("item_id", F.regexp_replace(text.squeeze(text.decomposed(F.col("text"))), r"\p{M}", "").alias("form"))


@query("sc02_title_form", f"SELECT item_id, {TITLE_FORM} AS form FROM benchmark")
def sc02(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.title_form(F.col("text")).alias("form"))


@query("sc03_author_parts", "SELECT p_partkey, split_part(p_name, ' ', 2) AS surname, substr(split_part(p_name, ' ', 1), 1, 1) AS initials FROM part")
def sc03(spark, sf):
    """Surname and initials of names written 'Widget, Cold'."""
    w = F.split("p_name", " ")
    parts = text.author_parts(F.initcap(F.concat(F.element_at(w, 2), F.lit(", "), F.element_at(w, 1))))
    return table(spark, sf, "part").select("p_partkey", parts["surname"].alias("surname"), parts["initials"].alias("initials"))


@query("sc04_author_list", "SELECT p_brand, sum(CASE WHEN n = 1 THEN 2 ELSE n END)::BIGINT AS n_authors FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def sc04(spark, sf):
    """Authors of lists cut at semicolons, one list for each brand and size; a list of one is cut at its comma."""
    w = F.split("p_name", " ")
    name = F.concat(F.element_at(w, 2), F.lit(", "), F.element_at(w, 1))
    lists = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.array_join(F.collect_list(name), "; ").alias("authors"))
    return lists.groupBy("p_brand").agg(F.sum(F.size(text.author_list(F.col("authors")))).alias("n_authors"))


@query("sc05_no_controls", r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g') AS form FROM documents")
def sc05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.no_controls(F.col("text")).alias("form"))


@query("sc10_content_words", f"SELECT item_id, len(CASE WHEN len(kept) > 0 THEN kept ELSE words END)::INTEGER AS n_words FROM (SELECT item_id, words, list_filter(words, lambda x: x NOT IN {fuzzy.STOP_WORDS!r}) AS kept FROM (SELECT item_id, list_distinct(string_split({TITLE_FORM}, ' ')) AS words FROM benchmark))")
def sc10(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(fuzzy.content_words(text.title_form(F.col("text")))).alias("n_words"))


@query("sc12_heading_form", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))), '^(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+|[a-z])[.)]?\s+', ''), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS heading FROM documents WHERE lang = 'en'")
def sc12(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", text.heading_form(F.substring_index("text", "\n", 1)).alias("heading"))


@query("sc44_page_match", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey = l_suppkey AS matches FROM lineitem")
def sc44(spark, sf):
    """First pages of two ranges, one with a hyphen and one with a dash, compared."""
    ours, theirs = F.concat_ws("-", "l_partkey", "l_orderkey"), F.concat_ws("–", "l_suppkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (fuzzy.first_page(ours) == fuzzy.first_page(theirs)).alias("matches"))


@query("sc45_features", """
SELECT l_orderkey, l_partkey, l_linenumber, round(1 / (1 + exp(-least(20.0, greatest(-20.0, -4.5 + 3.5 * l_discount * 10 + 2.2 * l_tax * 10 + 1.2 * (l_quantity / 50) + (l_linenumber = 1)::INT + 0.6 * (l_returnflag = 'A')::INT
  + 0.6 * (l_returnflag = 'N')::INT + 2.0 * l_discount * 10 + 1.5 * (l_linestatus = 'O')::INT - 0.5 * (l_linenumber = 3)::INT - 3.0 * (l_linenumber = 4)::INT + 0.1 * (l_linenumber = 2)::INT)))), 4) AS probability FROM lineitem""")
def sc45(spark, sf):
    """The eleven features of a reference and the probability they give."""
    yes = lambda c: F.expr(f"int({c})")
    features = {
        "title_similarity": F.col("l_discount") * 10, "author_similarity": F.col("l_tax") * 10, "journal_similarity": F.col("l_quantity") / 50, "year_match": yes("l_linenumber = 1"), "volume_match": yes("l_returnflag = 'A'"),
        "pages_match": yes("l_returnflag = 'N'"), "composite_score": F.col("l_discount") * 10, "doi_resolves": yes("l_linestatus = 'O'"), "is_redirect": yes("l_linenumber = 2"), "is_restricted": yes("l_linenumber = 3"), "is_retracted": yes("l_linenumber = 4"),
    }
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", fuzzy.probability(features).alias("probability"))


@query("sc47_predicted_label", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag <> 'A' AND l_linenumber = 4 THEN 'INVALID' WHEN l_returnflag = 'A' AND l_tax * 10 < 0.35 THEN 'WRONG_REFERENCE'
  WHEN l_quantity / 50 >= 0.75 THEN 'CORRECT' WHEN l_quantity / 50 >= 0.45 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS label FROM lineitem""")
def sc47(spark, sf):
    label = fuzzy.predicted_label(F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") == 4, 404).otherwise(200))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", label.alias("label"))


@query("sc49_coverage", f"""
WITH c AS (SELECT conv_id, turn, {WORDS} AS words FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.words) > 0 THEN len(list_intersect(a.words, b.words)) / len(a.words) ELSE 0.0 END AS coverage FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def sc49(spark, sf):
    """How many of a turn's words the next one takes up."""
    words = text.terms(F.col("text"), least=1)
    c = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next"))
    return c.join(following, ["conv_id", "turn"]).select("conv_id", "turn", fuzzy.coverage(F.col("words"), F.col("next")).alias("coverage"))


@query("sc62_route", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'GROUND_TRUTH' WHEN regexp_matches(coalesce(d.text, ''), '10\\.[0-9]{4,9}/') THEN 'EXPLICIT_DOI' ELSE 'RECOVER' END AS route FROM documents d LEFT JOIN labels l USING (doc_id)")
def sc62(spark, sf):
    """Which way a reference is validated: by deposited truth, by its own identifier, or by recovery of one."""
    known = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    route = F.when(F.col("quality") == 1, "GROUND_TRUTH").when(F.coalesce("text", F.lit("")).rlike(r"10\.[0-9]{4,9}/"), "EXPLICIT_DOI").otherwise("RECOVER")
    return known.select("doc_id", route.alias("route"))


@query("sc76_option", r"SELECT event_id, regexp_extract(props, '(-?[0-9]+)', 1) AS value FROM events WHERE regexp_matches(props, '[0-9]')")
def sc76(spark, sf):
    """The value of an option, written with a blank by even events and with = by odd ones."""
    number = F.regexp_extract("props", "(-?[0-9]+)", 1)
    command = F.concat(F.lit("python run.py --seed"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("="), number, F.lit(" --fast"))
    return table(spark, sf, "events").filter(F.col("props").rlike("[0-9]")).select("event_id", artifacts.option(command, "seed").alias("value"))


@query("sc91_clamped", "SELECT c_custkey, least(1.0, greatest(0.0, c_acctbal / 10000)) AS clamped, round(ln(1 + abs(c_acctbal)), 6) AS magnitude, isfinite(c_acctbal) AS finite FROM customer")
def sc91(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), b / 10000)).alias("clamped"), F.round(F.log(1 + F.abs(b)), 6).alias("magnitude"), (~F.isnan(b) & (F.abs(b) < float("inf"))).alias("finite"))


@query("sc92_year_rules", "SELECT o_orderkey, year(o_orderdate) >= 1998 - 5 AS recent, CASE WHEN year(o_orderdate) = 1995 THEN 1.0 WHEN abs(year(o_orderdate) - 1995) = 1 THEN 0.7 ELSE 0.0 END AS score FROM orders")
def sc92(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", (y >= 1998 - 5).alias("recent"), fuzzy.year_score(y, F.lit(1995)).alias("score"))


@query("sc93_lease_expiry", "SELECT event_id, ts + INTERVAL 60 SECOND AS expires, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def sc93(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("interval 60 seconds")).alias("expires"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("sc94_ordered_distinct", """
SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY ALL) GROUP BY 1""")
def sc94(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("sc95_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc95(spark, sf):
    """A map column read from JSON, written and read again."""
    parsed = F.from_json(F.to_json(F.from_json("props", "map<string,long>")), "map<string,long>")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("sc100_tampered", "SELECT doc_id, doc_id % 3 = 0 AS tampered FROM documents WHERE text IS NOT NULL")
def sc100(spark, sf):
    """Texts against the hashes recorded for them; a third of the records are of a changed text."""
    recorded = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256)
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", canonical.tampered(F.col("text"), recorded).alias("tampered"))


@query("ag08_median_age", "SELECT o_custkey, round(greatest(0, 1998 - median(year(o_orderdate)) FILTER (WHERE year(o_orderdate) BETWEEN 1900 AND 1999)), 1) AS median_age FROM orders GROUP BY 1")
def ag08(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).withColumn("benchmark", F.lit(1998))
    return aggregates.recency(o, "o_custkey", "year", "benchmark").select("o_custkey", "median_age")


@query("ag12_freshness", "SELECT o_custkey, CASE WHEN i >= 50 THEN 'CUTTING_EDGE' WHEN i >= 25 THEN 'BALANCED' ELSE 'DATED_OBSOLESCENT' END AS freshness FROM (SELECT o_custkey, round(100 * count(*) FILTER (WHERE year(o_orderdate) >= 1996) / count(*), 1) AS i FROM orders GROUP BY 1)")
def ag12(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).withColumn("benchmark", F.lit(2001))
    return aggregates.recency(o, "o_custkey", "year", "benchmark").select("o_custkey", aggregates.freshness(F.col("recency_index")).alias("freshness"))


LINES = """
SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.1) AS invalid, count(*) FILTER (WHERE l_quantity = 50) AS odd, 100.0 * count(*) FILTER (WHERE l_linenumber <= 3) / count(*) AS resolving, 100.0 * count(*) FILTER (WHERE l_tax < 0.07) / count(*) AS linked FROM lineitem GROUP BY 1"""


def _lines(spark, sf):
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") >= 0.1).alias("invalid"), F.count_if(F.col("l_quantity") == 50).alias("odd"), share(F.col("l_linenumber") <= 3).alias("resolving"), share(F.col("l_tax") < 0.07).alias("linked"))


@query("ag13_grade", f"""
SELECT l_orderkey, CASE WHEN invalid >= 3 THEN 'REQUIRES_REVISION' WHEN invalid >= 1 OR odd >= 2 THEN 'C' WHEN resolving >= 90 AND linked >= 85 THEN CASE WHEN linked >= 40 THEN 'A+' ELSE 'A' END
  WHEN resolving >= 75 OR linked >= 70 THEN 'B' WHEN resolving >= 50 THEN 'C' ELSE 'REQUIRES_REVISION' END AS grade FROM ({LINES})""")
def ag13(spark, sf):
    g = aggregates.grade(F.col("invalid"), F.col("odd"), F.col("resolving"), F.col("linked"), F.col("linked"))
    return _lines(spark, sf).select("l_orderkey", g.alias("grade"))


@query("ag16_executive_grade", f"SELECT l_orderkey, CASE WHEN invalid >= 3 THEN 'REQUIRES_REVISION' WHEN invalid >= 1 OR odd >= 1 THEN 'C' WHEN resolving >= 90 THEN 'A' ELSE 'B' END AS grade FROM ({LINES})")
def ag16(spark, sf):
    return _lines(spark, sf).select("l_orderkey", aggregates.executive_grade(F.col("invalid"), F.col("odd"), F.col("resolving")).alias("grade"))


@query("ag20_job_stats", "SELECT role, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM conversations GROUP BY 1")
def ag20(spark, sf):
    """Rows of each role and their share in percent."""
    per = aggregates.breakdown(table(spark, sf, "conversations"), "role")
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("role", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("ag21_cache_entries", "SELECT event_type AS namespace, count(DISTINCT user_id) AS entries FROM events GROUP BY 1")
def ag21(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("namespace")).agg(F.count_distinct("user_id").alias("entries"))


@query("ag24_dominant_style", """
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'UNKNOWN' WHEN a >= b THEN 'NUMERIC_BRACKETED' ELSE 'NUMERIC_SUPERSCRIPT' END AS style FROM (SELECT doc_id, (length(text) - length(replace(text, '.', ''))) % 4 AS a, (length(text) - length(replace(text, ',', ''))) % 4 AS b FROM documents)""")
def ag24(spark, sf):
    """The style of texts with as many markers of two families as their full stops and commas leave modulo 4."""
    n = lambda c: F.regexp_count("text", F.lit(c)) % 4
    body = F.concat(F.repeat(F.lit("as [12] shows "), n(r"\.")), F.repeat(F.lit("as said¹² before "), n(",")))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", citations.dominant_style(citations.marker_counts(body)).alias("style"))


@query("ag31_parameter_conflicts", "SELECT p_partkey, p_name, n_values FROM part JOIN (SELECT p_name, count(DISTINCT p_size) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1) USING (p_name)")
def ag31(spark, sf):
    return aggregates.conflicts(table(spark, sf, "part"), "p_name", F.col("p_size")).select("p_partkey", "p_name", "n_values")


@query("ag38_percentages", "SELECT lang, round(100.0 * count(*) FILTER (WHERE n_chars >= 1000) / count(*), 1) AS pct_long FROM documents GROUP BY 1")
def ag38(spark, sf):
    per = aggregates.group_summary(table(spark, sf, "documents"), "lang", "doc_id", [], {"long": F.col("n_chars") >= 1000, "n": F.lit(True)})
    return per.select("lang", F.round(100.0 * F.col("long") / F.col("n"), 1).alias("pct_long"))


@query("st09_sorted_results", "SELECT doc_id, source FROM documents ORDER BY doc_id")
def st09(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").select("doc_id", "source")


@query("snk04_review_queue", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus IN ('P')")
def snk04(spark, sf):
    o = table(spark, sf, "orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    return filters.for_review(o, "o_orderstatus", "urgent", ["P"]).select("o_orderkey", "o_orderstatus")


@query("cl01_item_filters", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%gear%' OR p_brand ILIKE '%gear%' OR p_type ILIKE '%gear%') AND p_size IS NOT NULL AND p_type = 'PROMO'")
def cl01(spark, sf):
    return filters.faceted(table(spark, sf, "part"), "gear", ["p_name", "p_brand", "p_type"], {"p_type": "PROMO"}).filter("p_size is not null").select("p_partkey")


@query("cl02_linked", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS linked FROM documents")
def cl02(spark, sf):
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("linked")).distinct()
    return table(spark, sf, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("cl03_link_auditor", "SELECT event_id FROM events WHERE event_type ILIKE '%err%' OR props ILIKE '%err%' OR event_id::VARCHAR ILIKE '%err%' OR user_id::VARCHAR ILIKE '%err%'")
def cl03(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "props", F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user"))
    return filters.faceted(e, "err", ["event_type", "props", "id", "user"]).select("event_id")


@query("cl07_target_split", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 0) AS eligible, count(*) FILTER (WHERE NOT (l_linestatus = 'O' AND l_quantity > 0)) AS ineligible FROM lineitem GROUP BY 1")
def cl07(spark, sf):
    ok = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("ineligible"))


@query("hl17_author_list", "SELECT p_brand, string_split(string_agg(p_name, ';' ORDER BY p_partkey), ';')[1] AS first_author, count(*)::INTEGER AS n FROM part GROUP BY 1")
def hl17(spark, sf):
    """The first author and the number of authors of a list joined by semicolons."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    lists = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(names, ";").alias("authors"))
    return lists.select("p_brand", F.element_at(F.split("authors", ";"), 1).alias("first_author"), F.size(F.split("authors", ";")).alias("n"))
