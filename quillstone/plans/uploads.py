"""Queries of uploads: each order is a file in one of three formats, whose lines are its references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.spread import spread
from quillstone.plans.registry import query
from quillstone.plans.tables import table
from quillstone.sources import index_records, uploads


@query("src02_uploads", r"""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name, 1990 + l_linenumber AS yr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'f' || l_orderkey || CASE l_orderkey % 3 WHEN 0 THEN '.txt' ELSE '.csv' END AS path, CASE l_orderkey % 3 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'ROWS' ELSE 'EXPORT' END AS route,
       CASE l_orderkey % 3 WHEN 2 THEN 'eid-' || l_orderkey WHEN 0 THEN 'f' || l_orderkey || '.txt' ELSE 'f' || l_orderkey || '.csv' END AS source, k::BIGINT AS reference_no,
       CASE l_orderkey % 3 WHEN 0 THEN '[' || k || '] Lee A. On ' || p_name || ', ' || yr || '.' WHEN 2 THEN 'Smith J., On ' || p_name || ', pp. ' || l_suppkey || ', (' || yr || ')'
            ELSE CASE WHEN l_linenumber % 2 = 1 THEN 'Said "' || p_name || '",' || chr(10) || 'twice' ELSE 'On ' || p_name || '. DOI: 10.1/' || l_partkey END END AS raw_reference,
       CASE WHEN l_orderkey % 3 = 1 THEN '10.1/' || l_partkey ELSE '' END AS doi, CASE WHEN l_orderkey % 3 = 1 THEN 'On ' || p_name ELSE '' END AS title FROM l""")
def src02(spark, sf):
    """References of texts, of tables with a reference in a row, and of exports with all of a document's in one cell."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").join(part, "l_partkey").withColumn("yr", (F.col("l_linenumber") + 1990).cast("string"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_name", "yr"))).alias("of"))
    kind, key = F.col("l_orderkey") % 3, F.col("l_orderkey").cast("string")
    joined = lambda f, between: F.array_join(F.transform("of", f), between)
    text = F.concat(F.concat(F.repeat(F.lit("A body of few words.\n"), 40), F.lit("References\n")), joined(lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Lee A. On "), x["p_name"], F.lit(",\n"), x["yr"], F.lit(".")), "\n"))
    said = lambda x: F.when(x["l_linenumber"] % 2 == 1, F.concat(F.lit('"Said ""'), x["p_name"], F.lit('"",\ntwice"'))).otherwise("None")
    rows = F.concat(F.lit("﻿ DOI ,Article_Title,Citation\n"), joined(lambda x, i: F.concat(F.lit("10.1/"), x["l_partkey"].cast("string"), F.lit(",On "), x["p_name"], F.lit(","), said(x)), "\n"), F.lit("\n,,\n"))
    whole = joined(lambda x, i: F.concat(F.lit("Smith J., On "), x["p_name"], F.lit(", pp. "), x["l_suppkey"].cast("string"), F.lit(", ("), x["yr"], F.lit(")")), "; ")
    export = F.concat(F.lit("EID,References\r\neid-"), key, F.lit(',"'), whole, F.lit('"\r\n'))
    name = F.concat(F.lit("f"), key, F.when(kind == 0, ".txt").otherwise(".csv"))
    content = F.when(kind == 0, text).when(kind == 1, rows).otherwise(export)
    return uploads.references_of(orders.select(name.alias("path"), content.cast("binary").alias("content")))


@query("prj09_index_records", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey::VARCHAR AS scopus_id, l_returnflag <> 'N' AS scopus_linked, CASE WHEN l_quantity > 25 THEN 'On ' || p_name ELSE 'Journal ' || l_suppkey END AS title,
       CASE WHEN l_returnflag <> 'R' AND l_discount = 0 THEN 1800 + l_linenumber ELSE 1990 + l_linenumber END AS year, 'Lee A.; Fox ' || l_linenumber AS authors, l_partkey || '-' || (l_partkey + 9) AS pages
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' UNION ALL
SELECT l_orderkey, l_partkey, l_linenumber, '', false, 'On ' || p_name || '. ' || l_suppkey, 1990 + l_linenumber, '', ''
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'""")
def prj09(spark, sf):
    """Each line as a listed reference: with its fields at the top (A), nested (R), or as a text alone (N)."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    # The few columns are dealt out by the join's key, one exchange whatever the join; payloads are made and read behind it.
    lines = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount"), "l_partkey").join(part, "l_partkey")
    text = lambda c: F.col(c).cast("string")
    title, journal, year = F.when(F.col("l_quantity") > 25, F.concat(F.lit("On "), "p_name")), F.concat(F.lit("Journal "), text("l_suppkey")), (F.col("l_linenumber") + 1990).cast("string")
    authors = F.struct(F.array(F.struct(F.lit("Lee A.").alias("ce:indexed-name")), F.struct(F.concat(F.lit("Fox "), text("l_linenumber")).alias("ce:indexed-name"))).alias("author"))
    pages = F.struct(text("l_partkey").alias("@first"), (F.col("l_partkey") + 9).cast("string").alias("@last")).alias("pagerange")
    volume = F.struct((F.col("l_linenumber") + 1800).cast("string").alias("@volume")).alias("voliss")
    dated = F.when(F.col("l_discount") != 0, F.concat(year, F.lit("-02-01")))
    top = F.to_json(F.array(F.struct(F.lit("1").alias("@id"), F.lit("resolvedReference").alias("type"), text("l_suppkey").alias("scopus-id"), title.alias("title"), F.struct(journal.alias("$")).alias("sourcetitle"), dated.alias("prism:coverDate"), F.struct(volume, pages).alias("volisspag"), authors.alias("author-list"))))
    ids = F.struct(F.struct(F.lit("SGR").alias("@idtype"), text("l_suppkey").alias("$")).alias("itemid"))
    nested = F.to_json(F.array(F.struct(F.lit("1").alias("@id"), F.struct(ids.alias("refd-itemidlist"), F.struct(title.alias("ref-titletext")).alias("ref-title"), journal.alias("ref-sourcetitle"), F.struct(year.alias("@first")).alias("ref-publicationyear"), F.struct(pages).alias("ref-volisspag"), authors.alias("ref-authors")).alias("ref-info"))))
    alone = F.to_json(F.array(F.struct(F.struct(F.struct(year.alias("@first")).alias("ref-publicationyear")).alias("ref-info"), F.concat(F.lit("7. Lee A. On "), "p_name", F.lit(". "), text("l_suppkey"), F.lit(". [Internet] seen")).alias("ref-fulltext"))))
    payload = F.when(F.col("l_returnflag") == "A", top).when(F.col("l_returnflag") == "R", nested).otherwise(alone)
    rows = lines.select(F.struct("l_orderkey", "l_partkey", "l_linenumber").alias("k"), payload.alias("p"))
    return index_records.listed_references(rows, "k", "p").select("k.*", "scopus_id", "scopus_linked", "title", "year", "authors", "pages")
