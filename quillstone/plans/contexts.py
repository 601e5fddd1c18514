"""Queries of sections and of the context that is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import documents, similarity
from quillstone.plans.registry import query
from quillstone.plans.tables import table

#: Headings of the turns of a conversation, and what kind of section each starts.
HEADINGS = ("Abstract", "1 Introduction", "2 Related Work", "3 M ETHODS", "IV Other Matters", "5 Results and Discussion", "Conclusions", "References")
KINDS = ("ABSTRACT", "INTRODUCTION", "RELATED_WORK", "METHODS", "OTHER", "RESULTS", "CONCLUSION", "REFERENCES")


def _papers(spark, sf) -> DataFrame:
    """Each conversation as a paper: a heading before each turn."""
    c = table(spark, sf, "conversations").filter("text is not null")
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), F.pmod("turn", F.lit(len(HEADINGS))).cast("int") + 1)
    said = F.concat(heading, F.lit("\n"), F.col("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "\n\n")
    return c.groupBy("conv_id").agg(whole.alias("text"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SECTIONS_SQL = f"""
WITH s AS (SELECT conv_id, turn, {_list(HEADINGS)}[1 + turn % 8] AS title, {_list(KINDS)}[1 + turn % 8] AS section_type, {_list(HEADINGS)}[1 + turn % 8] || chr(10) || text AS said FROM conversations WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(said) + 2) OVER w, 0)::BIGINT AS start, trim(said, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("tvf09_typed_sections", f"""
{SECTIONS_SQL}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS number, section_type, title, start, length(body)::BIGINT AS n_chars FROM o""")
def tvf09_typed(spark, sf):
    """Sections with their kinds, found by their headings alone."""
    return documents.sections(_papers(spark, sf), "conv_id", "text").select("conv_id", "number", "section_type", "title", "start", F.length("text").cast("long").alias("n_chars"))


@query("tvf12_context", f"""
{SECTIONS_SQL},
d AS (
  SELECT conv_id, count(*)::INTEGER AS sections_detected, (max(start + length(said)))::BIGINT AS total_characters, sum(length(body)) FILTER (section_type <> 'REFERENCES')::BIGINT AS of_selected,
         sum(length('[' || section_type || ': ' || title || ']' || chr(10)) + length(body) + 2) FILTER (section_type <> 'REFERENCES')::BIGINT - 2 AS of_chunk,
         string_agg(section_type, ',' ORDER BY turn) FILTER (section_type <> 'REFERENCES') AS kinds, count(*) FILTER (section_type <> 'REFERENCES') >= 2 AND count(*) FILTER (section_type NOT IN ('REFERENCES', 'OTHER', 'RELATED_WORK')) > 0 AS reliable,
         string_agg(said, chr(10) || chr(10) ORDER BY turn) AS whole
  FROM o GROUP BY conv_id)
SELECT conv_id, NOT reliable AS fallback, total_characters, sections_detected, CASE WHEN reliable THEN kinds ELSE 'OTHER' END AS kinds, CASE WHEN reliable THEN of_selected ELSE length(whole) END::BIGINT AS selected_characters,
       1 AS chunks_created, CASE WHEN reliable THEN of_chunk ELSE length('[OTHER: Bounded full text]' || chr(10) || whole) END::BIGINT AS input_characters FROM d""")
def tvf12(spark, sf):
    """The prepared context of every conversation: kinds of the selected sections and the diagnostics."""
    kinds = F.array_join(F.transform("selected", lambda s: s["section_type"]), ",").alias("kinds")
    return documents.prepare(_papers(spark, sf), "conv_id", "text").select("conv_id", "fallback", "total_characters", "sections_detected", kinds, "selected_characters", "chunks_created", "input_characters")


@query("sc70_heading_lines", r"""
WITH f AS (SELECT doc_id, '3.1 ' || trim(unnest(string_split(coalesce(text, ''), '. ')), ' ') AS line FROM documents),
v AS (SELECT doc_id, trim(regexp_replace(line, '[\x09-\x0D ]+', ' ', 'g'), ' ') AS line FROM f)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (length(line) <= 100 AND len(string_split(line, ' ')) <= 11 AND NOT regexp_matches(line, '[.;,:]$') AND regexp_matches(line, '^\d+(\.\d+)*\.? +[A-Z][^.!?]{1,90}$'))::BIGINT AS n_headings
FROM v GROUP BY doc_id""")
def sc70(spark, sf):
    """How many of a document's sentences, with a number before them, read as headings."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("s")).withColumn("line", F.concat(F.lit("3.1 "), F.trim("s")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(documents.is_heading(F.col("line")), 1)).alias("n_headings"))


@query("jn07_claim_citations")
def jn07_claims(spark, sf):
    """The assistant's turns of its conversation that each user's turn resembles, each turn a reference with its number."""
    c = table(spark, sf, "conversations").filter("text is not null and conv_id is not null and turn is not null")
    said = c.filter("role = 'assistant'")
    claims = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("claim_id"), F.col("text").alias("claim_text"))
    none = F.lit(None).cast("string")
    citations = said.select("conv_id", F.col("turn").alias("citation_id"), F.col("turn").alias("place"), F.array(F.col("turn").cast("long")).alias("keys"), F.format_string("[%d]", "turn").alias("marker"), none.alias("content"), none.alias("author"), none.alias("year"), F.col("text").alias("context"))
    references = said.select("conv_id", F.format_string("R%d", "turn").alias("reference_id"), F.col("turn").cast("long").alias("number"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"))
    return similarity.map_claims(claims, citations, references, "conv_id").select("conv_id", "claim_id", "rank", "reference_id", "similarity")


@query("jn03_repaired_places")
def jn03_places(spark, sf):
    """The ground truth of each order's lines, whose rows are one place off in every second order."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    refs = lines.select("l_orderkey", F.row_number().over(w).alias("reference_no"), F.concat("p_name", F.lit(" of supplier "), "l_suppkey").alias("title"))
    ground = refs.select("l_orderkey", (F.col("reference_no") + F.col("l_orderkey") % 2).cast("int").alias("reference_no"), F.upper("title").alias("title"))
    return similarity.repaired_places(refs, ground, "l_orderkey")
