"""Roll-ups: conditional KPI rows, breakdowns, representatives, indicators, verdict folds (AG01-AG38)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kpi_row(df: DataFrame, distinct: str, conditions: Mapping[str, Column], total: str = "total", units: str = "units") -> DataFrame:
    """One row: count, distinct count and a conditional sum for each condition (null over no rows), in one pass."""
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]
    return df.agg(F.count("*").alias(total), F.count_distinct(F.col(distinct)).alias(units), *sums)


def breakdown(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Rows for each value, most frequent first, names as tie-break."""
    return df.groupBy(column).agg(F.count("*").alias(count)).orderBy(F.col(count).desc(), F.col(column).asc_nulls_first())


def group_summary(df: DataFrame, key: str, by: str, carried: Iterable[str], counts: Mapping[str, Column]) -> DataFrame:
    """For each key its counts, and the carried columns of its first row by ``by``."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.col(by)).alias(c) for c in carried], *[F.count_if(c).alias(n) for n, c in counts.items()])


def recency(df: DataFrame, key: str, year: str, benchmark: str, window: int = 5) -> DataFrame:
    """For each key the share of years within ``window`` of the benchmark, and the median age; 0 without years.

    Years outside 1900 to a year past the benchmark do not count.
    """
    y = F.when(F.col(year).between(1900, F.col(benchmark) + 1), F.col(year))
    recent = F.count_if(y >= F.col(benchmark) - window)
    share = F.coalesce(F.round(100 * recent / F.nullif(F.count(y), F.lit(0)), 1), F.lit(0.0))
    age = F.round(F.greatest(F.lit(0.0), F.max(benchmark) - F.median(y)), 1)
    return df.groupBy(key).agg(share.alias("recency_index"), age.alias("median_age"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count(y).alias("n_years"))


def diversity(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the normalised entropy of its values: 1 with under two values or rows, 0 without any."""
    per = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    p = F.col("n") / F.sum("n").over(w)
    per = per.select(key, "n", (-p * F.log(p)).alias("part"))
    out = per.groupBy(key).agg(F.sum("part").alias("h"), F.count("*").alias("k"), F.sum("n").alias("total"))
    value_of = F.when((F.col("k") < 2) | (F.col("total") < 2), F.lit(1.0)).otherwise(F.round(F.col("h") / F.log(F.col("k")), 2))
    keys = df.select(key).distinct()
    return keys.join(out, key, "left").select(key, F.coalesce(value_of, F.lit(0.0)).alias("diversity"), F.coalesce("k", F.lit(0)).alias("n_values"))


def primary_category(df: DataFrame, key: str, category: str, position: str) -> DataFrame:
    """For each key its most frequent category, the one seen first on ties, with the distribution as a map."""
    per = df.groupBy(key, category).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    best = F.max_by(F.col(category), F.struct(F.col("n"), -F.col("seen")))
    return per.groupBy(key).agg(best.alias("primary"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "n")))).alias("distribution"))


def audit_indicators(refs: DataFrame, key: str, cited: str, venue: str, order: str, current_year: int = 2026, top: int = 5) -> DataFrame:
    """The second set of indicators, of a single audit: cited years up to the current one, the top venues, risk
    left to its own rule. It differs from ``recency`` on purpose and is not to be mixed with it."""
    y = F.when(F.col(cited).between(1900, current_year), F.col(cited))
    share = F.coalesce(F.round(100 * F.count_if(y >= current_year - 5) / F.nullif(F.count(y), F.lit(0)), 1), F.lit(0.0))
    base = refs.groupBy(key).agg(share.alias("recency_index"), F.round(F.greatest(F.lit(0.0), current_year - F.median(y)), 1).alias("median_age"), F.count("*").alias("n_references"))
    per = refs.filter(F.coalesce(F.col(venue), F.lit("")) != "").groupBy(key, venue).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    ranked = per.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "seen"))).filter(F.col("k") <= top)
    venues = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", venue))), lambda x: x[venue]).alias("top_venues"))
    return base.join(venues, key, "left")


def risk(invalid: Column, discrepancies: Column) -> Column:
    """HIGH with three invalid or more, MEDIUM with any invalid or discrepancy, else LOW."""
    return F.when(invalid >= 3, "HIGH").when((invalid >= 1) | (discrepancies >= 1), "MEDIUM").otherwise("LOW")


def freshness(index: Column) -> Column:
    """Band of a recency index in percent."""
    return F.when(index >= 50, "CUTTING_EDGE").when(index >= 25, "BALANCED").otherwise("DATED_OBSOLESCENT")


def grade(invalid: Column, discrepancies: Column, resolving: Column, linked: Column, index: Column) -> Column:
    """Integrity grade from counts and percentages; the first rule that holds decides."""
    return (
        F.when(invalid >= 3, "REQUIRES_REVISION")
        .when((invalid >= 1) | (discrepancies >= 2), "C")
        .when((resolving >= 90) & (linked >= 85), F.when(index >= 40, "A+").otherwise("A"))
        .when((resolving >= 75) | (linked >= 70), "B")
        .when(resolving >= 50, "C")
        .otherwise("REQUIRES_REVISION")
    )


def executive_grade(invalid: Column, discrepancies: Column, consistency_score: Column) -> Column:
    """The second, coarser grade of a single audit."""
    return F.when(invalid >= 3, "REQUIRES_REVISION").when((invalid >= 1) | (discrepancies >= 1), "C").when(consistency_score >= 90, "A").otherwise("B")


def blind_spots(index: Column, invalid: Column, diversity: Column) -> Column:
    """Codes of what a bibliography lacks; SOUND where it lacks nothing."""
    found = F.array_compact(F.array(F.when(index < 20, "LOW_RECENCY"), F.when(invalid > 0, "BROKEN_IDENTIFIERS"), F.when(diversity < 0.4, "NARROW_VENUES")))
    return F.when(F.size(found) == 0, F.array(F.lit("SOUND"))).otherwise(found)


def consistency(cited: Column, listed: Column) -> Column:
    """A struct for two arrays of numbers: orphans, missing, gaps up to the greatest cited one, and the score."""
    orphans, missing = F.array_except(listed, cited), F.array_except(cited, listed)
    top = F.array_max(cited)
    gaps = F.when(top.isNull() | (top < 1), F.array().cast("array<long>")).otherwise(F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(top.cast("long"), F.lit(1).cast("long"))), cited.cast("array<long>")))
    penalty = (1.5 * F.size(orphans) + 3 * F.size(missing)) / F.greatest(F.lit(1), F.size(listed)) * 100
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - penalty)), 1)
    return F.struct(F.array_sort(orphans).alias("orphans"), F.array_sort(missing).alias("missing"), F.array_sort(gaps).alias("gaps"), score.alias("score"))


def verdict(statuses: Column) -> Column:
    """Conservative fold of an array of statuses: a blocked one blocks, doubt and contradiction are inconclusive."""
    known = ("VERIFIED", "PARTIALLY_VERIFIED", "NOT_REPRODUCED", "INCONCLUSIVE", "BLOCKED")
    has = lambda s: F.array_contains(statuses, s)
    odd = F.size(F.array_except(statuses, F.array(*[F.lit(k) for k in known]))) > 0
    return (
        F.when(has("BLOCKED"), "BLOCKED")
        .when((F.size(statuses) == 0) | odd | has("INCONCLUSIVE"), "INCONCLUSIVE")
        .when(has("VERIFIED") & has("NOT_REPRODUCED"), "INCONCLUSIVE")
        .when(has("NOT_REPRODUCED"), "NOT_REPRODUCED")
        .when(has("PARTIALLY_VERIFIED"), "PARTIALLY_VERIFIED")
        .otherwise("VERIFIED")
    )


def hypothesis_status(outcomes: Column) -> Column:
    """Fold of diagnostic outcomes: support and contradiction together are inconclusive, and so is neither."""
    has = lambda s: F.array_contains(outcomes, s)
    return (
        F.when(has("SUPPORTING") & has("CONTRADICTING"), "INCONCLUSIVE")
        .when(has("SUPPORTING") & (has("INCONCLUSIVE") | has("BLOCKED")), "WEAKLY_SUPPORTED")
        .when(has("SUPPORTING"), "SUPPORTED")
        .when(has("CONTRADICTING"), "REJECTED")
        .otherwise("INCONCLUSIVE")
    )


def conflicts(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows of the keys that have more than one distinct non-null value."""
    valued = df.withColumn("__v", value).filter("__v is not null")
    bad = valued.groupBy(key).agg(F.count_distinct("__v").alias("n_values")).filter("n_values > 1")
    return valued.join(bad, key).drop("__v")


def resolved(df: DataFrame, key: str, value: Column) -> DataFrame:
    """For each key its value where all agree, else null and the number of values."""
    per = df.select(key, value.alias("__v")).groupBy(key).agg(F.count_distinct("__v").alias("n_values"), F.min("__v").alias("__v"))
    return per.select(key, "n_values", F.when(F.col("n_values") == 1, F.col("__v")).alias("value"))


def merge_parts(df: DataFrame, key: str, order: str, first: Sequence[str], longest: Sequence[str]) -> DataFrame:
    """One row for each key: the first non-null of some columns, the longest of others (the first on ties)."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    longs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(order)))).alias(c) for c in longest]
    return df.groupBy(key).agg(*firsts, *longs)


def domain_scores(df: DataFrame, key: str, fields: Mapping[str, int], words: DataFrame) -> DataFrame:
    """Score of each domain for each row: every keyword found in a field adds the field's weight.

    ``words`` (domain, word) is a fixed vocabulary, whose size is checked before it is broadcast.
    """
    if words.count() > 10_000:
        raise ValueError("a vocabulary has at most 10,000 words")
    vocabulary = words.groupBy("domain").agg(F.collect_list("word").alias("words")).agg(F.collect_list(F.struct("domain", "words")).alias("vocabulary"))
    hits = lambda w: sum(F.when(F.lower(F.coalesce(F.col(f), F.lit(""))).contains(w), n).otherwise(0) for f, n in fields.items())
    score = lambda d: F.aggregate(d["words"], F.lit(0).cast("long"), lambda total, w: total + hits(w))
    per = df.join(F.broadcast(vocabulary)).select(F.col(key), F.explode(F.transform("vocabulary", lambda d: F.struct(d["domain"].alias("domain"), score(d).alias("score")))).alias("d"))
    return per.groupBy(key, "d.domain").agg(F.sum("d.score").alias("score"))


def running_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """First and last non-blank lines that stand on at least max(2, pages // 2) pages of a document of 3 or more.

    One row of ``df`` is a page.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pages = df.select(doc, F.get(lines, F.lit(0)).alias("head"), F.get(lines, F.size(lines) - 1).alias("foot"))
    counts = pages.groupBy(doc).agg(F.count("*").alias("pages")).filter("pages >= 3")
    ends = pages.select(doc, F.explode(F.array_distinct(F.array_compact(F.array("head", "foot")))).alias("line"))
    per = ends.groupBy(doc, "line").agg(F.count("*").alias("n"))
    return per.join(counts, doc).filter("n >= greatest(2, pages div 2)").select(doc, "line", "n", "pages")
