"""The entry points of the audit service as functions over a table of verified references (EP01-EP06, EP14).

Every function returns DataFrames; nothing is collected. ``refs`` has reference_id, source_eid, source_title,
raw_reference, resolved_title, resolved_authors, normalized_doi, final_status, confidence, scopus_link_valid,
needs_human_review and what else a caller likes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import aggregates, filters, graph, paging, state
from quillstone.operators.indicators import document_indicators
from quillstone.sources import sinks

SEARCHED = ("raw_reference", "resolved_title", "normalized_doi", "reference_id", "source_title", "resolved_authors")
#: Columns by which a page may be ordered.
SORTABLE = ("reference_id", "source_eid", "final_status", "confidence", "composite_score", "cited_year", "http_status")


def stats(refs: DataFrame) -> dict[str, DataFrame]:
    """The row of key figures and the breakdowns by status and confidence."""
    has = lambda s: F.col("final_status") == s
    figures = {s.lower(): has(s) for s in ("VALID_CORRECT", "VALID_DOI_WRONG_REFERENCE", "INVALID_DOI", "DOI_RECOVERED", "ACCESS_RESTRICTED", "METADATA_MISMATCH", "SCOPUS_UNLINKED")}
    figures |= {"linked": F.col("scopus_link_valid"), "review": F.col("needs_human_review"), "with_doi": F.col("normalized_doi") != ""}
    return {"kpis": aggregates.kpi_row(refs, "source_eid", figures, "total_references", "total_documents"), "statuses": aggregates.breakdown(refs, "final_status"), "confidences": aggregates.breakdown(refs, "confidence")}


def found(refs: DataFrame, search: str | None = None, status: str | None = None, confidence: str | None = None, linked: bool | None = None, review: bool | None = None, has_doi: bool | None = None, source_eid: str | None = None) -> DataFrame:
    """References that meet all the facets given."""
    df = filters.faceted(refs, search, SEARCHED, {"final_status": status, "confidence": confidence}, {"scopus_link_valid": linked, "needs_human_review": review}, {"normalized_doi": has_doi})
    return df.filter(F.col("source_eid") == source_eid) if source_eid else df


def references(refs: DataFrame, page: int = 1, size: int = 50, sort_by: str | None = None, direction: str = "asc", **facets) -> tuple[DataFrame, DataFrame]:
    """One page of the references found, and the row of totals."""
    df = found(refs, **facets)
    allowed = [c for c in SORTABLE if c in refs.columns]
    return paging.page(df, paging.ordering(sort_by, direction, allowed, "reference_id", "reference_id"), page, size), paging.page_count(df, size)


def reference(refs: DataFrame, reference_id: str) -> DataFrame:
    return refs.filter(F.col("reference_id") == reference_id)


def reviewed(refs: DataFrame, reviews: DataFrame) -> DataFrame:
    """References under the reviewers' marks, notes and changed statuses."""
    return state.review_overlay(refs, reviews, "reference_id")


def documents(refs: DataFrame, search: str | None = None, most: int = 100) -> DataFrame:
    """Documents with their counts, most references first."""
    counts = {"ref_count": F.lit(True), "linked_count": F.col("scopus_link_valid"), "review_count": F.col("needs_human_review")}
    df = aggregates.group_summary(refs, "source_eid", "reference_id", ["source_title"], counts)
    return df.filter(filters.search(search, ["source_title", "source_eid"])).orderBy(F.col("ref_count").desc(), "source_eid").limit(most)


def indicators(refs: DataFrame, page: int = 1, size: int = 50, search: str | None = None, grades: Iterable[str] | None = None, risks: Iterable[str] | None = None) -> DataFrame:
    """A page of the documents' indicators, most references first."""
    df = filters.faceted(document_indicators(refs), search, ["source_title", "source_eid"], {"grade": grades, "risk": risks})
    return paging.page(df, paging.ordering("total_references", "desc", ["total_references"], "total_references", "source_eid"), page, size)


def document(refs: DataFrame, source_eid: str) -> DataFrame:
    """One document with its references, nested in the order of their ids."""
    return refs.filter(F.col("source_eid") == source_eid).groupBy("source_eid").agg(F.array_sort(F.collect_list(F.struct("reference_id", "raw_reference", "final_status"))).alias("references"))


def export(refs: DataFrame, **facets) -> DataFrame:
    return sinks.export(found(refs, **facets), [F.col("reference_id")])


def provenance(edges: DataFrame, node: str) -> DataFrame:
    return graph.neighbourhood(edges, node)
