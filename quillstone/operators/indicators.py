"""Everything known of a document from its verified references, in one pass over them (AG06-AG14, PRJ, SC67)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.ladders import by_words
from quillstone.operators import aggregates

#: Words of a reference that tell its stance, in the order of their priority.
STANCE_WORDS = (
    ("CRITIQUE", ("limitation", "drawback", "bottleneck", "flaw", "gap", "issue", "critique", "unresolved")),
    ("COMPARISON", ("benchmark", "baseline", "compared", "versus", "outperform", "state-of-the-art", "evaluation", "metric")),
    ("METHODOLOGY", ("method", "algorithm", "framework", "architecture", "model", "technique", "approach")),
)


def document_indicators(refs: DataFrame, benchmark_year: int = 2026) -> DataFrame:
    """One row for each source_eid.

    ``refs`` has source_eid, reference_no, source_title, source_year, resolved_year, raw_reference,
    resolved_title, journal, final_status, http_status, doi_resolves, scopus_linked. Metadata come from the
    document's first reference; the benchmark year is the document's own where that is plausible.
    """
    from quillstone.functions.citations import YEAR_BARE

    c = F.col
    own = F.when(c("source_year").between(1900, benchmark_year), c("source_year")).otherwise(benchmark_year)
    year = F.coalesce(c("resolved_year"), F.try_element_at(F.regexp_extract_all(c("raw_reference"), F.lit(YEAR_BARE), F.lit(1)), F.lit(-1)).try_cast("int"))
    venue = F.when((F.length("journal") > 2) & ~F.lower("journal").isin("unknown", "n/a", "{}"), c("journal"))
    stance = by_words(F.concat_ws(" ", "raw_reference", "resolved_title"), STANCE_WORDS, "BACKGROUND")
    invalid = (c("final_status") == "INVALID_DOI") | (c("http_status") == 404)
    rows = refs.select("source_eid", "reference_no", "source_title", own.alias("b"), year.alias("y"), venue.alias("venue"), stance.alias("stance"), F.coalesce(invalid, F.lit(False)).alias("invalid"), (c("final_status") == "VALID_DOI_WRONG_REFERENCE").alias("wrong"), "doi_resolves", "scopus_linked")
    pct = lambda n: F.round(100.0 * n / F.count("*"), 1)
    base = rows.groupBy("source_eid").agg(
        F.min_by("source_title", "reference_no").alias("source_title"), F.count("*").alias("total_references"), F.count_if("invalid").alias("invalid_dois"), F.count_if("wrong").alias("discrepancies"),
        F.count_if("doi_resolves").alias("resolving_dois"), F.count_if("scopus_linked").alias("linked"), pct(F.count_if("doi_resolves")).alias("resolving_pct"), pct(F.count_if("scopus_linked")).alias("linked_pct"),
    )
    recent = aggregates.recency(rows, "source_eid", "y", "b")
    venues = aggregates.diversity(rows, "source_eid", "venue")
    stances = aggregates.primary_category(rows, "source_eid", "stance", "reference_no")
    top = rows.filter("venue is not null").groupBy("source_eid", "venue").agg(F.count("*").alias("n"), F.min("reference_no").alias("seen"))
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("source_eid").orderBy(F.col("n").desc(), "seen"))).filter("k <= 3")
    top = top.groupBy("source_eid").agg(F.array_sort(F.collect_list(F.struct("k", "venue", "n"))).alias("top"))
    out = base.join(recent, "source_eid").join(venues, "source_eid").join(stances, "source_eid").join(top, "source_eid", "left")
    return out.withColumns({
        "risk": aggregates.risk(c("invalid_dois"), c("discrepancies")), "freshness": aggregates.freshness(c("recency_index")),
        "grade": aggregates.grade(c("invalid_dois"), c("discrepancies"), c("resolving_pct"), c("linked_pct"), c("recency_index")),
        "blind_spots": aggregates.blind_spots(c("recency_index"), c("invalid_dois"), c("diversity")),
        "top_venues": F.array_join(F.transform(F.coalesce("top", F.array().cast("array<struct<k: int, venue: string, n: bigint>>")), lambda t: F.concat(t["venue"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", "),
    }).drop("top")
