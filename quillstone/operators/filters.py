"""Faceted filters: substring search over several columns, membership facets, tri-state flags (F01-F14)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that put a reference into the review queue.
REVIEW_STATUSES = (
    "VALID_DOI_WRONG_REFERENCE", "METADATA_MISMATCH", "AMBIGUOUS", "DOI_RECOVERY_UNCERTAIN", "RETRACTED_REFERENCE", "INVALID_DOI", "BROKEN_URL",
)


def search(term: str | None, columns: Iterable[str]) -> Column:
    """Whether any column contains the trimmed term, regardless of case. ``%`` and ``_`` stay wildcards."""
    term = (term or "").strip()
    if not term:
        return F.lit(True)
    return reduce(or_, [F.col(c).ilike(f"%{term}%") for c in columns])


def member(column: str, values: str | Iterable[str] | None) -> Column:
    """Membership in a list or a comma-separated text; no values mean no restriction."""
    values = values.split(",") if isinstance(values, str) else list(values or ())
    values = [v.strip() for v in values if v.strip()]
    return F.col(column).isin(values) if values else F.lit(True)


def flag(column: str, want: bool | None) -> Column:
    """True, false or no restriction; a null flag is neither."""
    return F.lit(True) if want is None else F.col(column) == F.lit(want)


def present(column: str, want: bool | None) -> Column:
    """Whether a text is there: '' and null are both absent."""
    if want is None:
        return F.lit(True)
    return F.col(column) != "" if want else (F.col(column) == "") | F.col(column).isNull()


def faceted(df: DataFrame, term: str | None = None, columns: Iterable[str] = (), members: Mapping[str, str | Iterable[str] | None] = {}, flags: Mapping[str, bool | None] = {}, presence: Mapping[str, bool | None] = {}) -> DataFrame:
    """All facets at once, as one conjunction that the scan can take."""
    conditions = [search(term, columns), *[member(c, v) for c, v in members.items()], *[flag(c, v) for c, v in flags.items()], *[present(c, v) for c, v in presence.items()]]
    return reduce(DataFrame.filter, conditions, df)


def for_review(df: DataFrame, status: str = "final_status", needs: str = "needs_human_review", statuses: Iterable[str] = REVIEW_STATUSES) -> DataFrame:
    """Rows marked for review or with a status that needs it."""
    return df.filter(F.coalesce(F.col(needs), F.lit(False)) | F.col(status).isin(list(statuses)))


def wrong_identifier(score: str, status: str, resolves: str, bad_status: str = "VALID_DOI_WRONG_REFERENCE") -> Column:
    """A resolving identifier that leads to another work."""
    return (F.col(status) == bad_status) | ((F.col(score) < 0.45) & F.col(resolves))


def first_matching_probe(df: DataFrame, probes: Iterable[Column]) -> DataFrame:
    """Rows of the first probe, in the order given, that any row meets."""
    rank = F.coalesce(*[F.when(p, F.lit(i)) for i, p in enumerate(probes)])
    ranked = df.withColumn("__probe", rank).filter("__probe is not null")
    best = ranked.agg(F.min("__probe").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__probe") == F.col("__best")).drop("__probe", "__best")


def without_secrets(column: Column) -> Column:
    """A map without the entries whose key speaks of a secret."""
    return F.map_filter(column, lambda k, _: ~F.lower(k).rlike("secret|token|password|key"))
