"""Ordering by a whitelisted column, pages, top rows of groups (ST01-ST10)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(sort_by: str | None, direction: str | None, allowed: Iterable[str], default: str, tie: str) -> list[Column]:
    """Order columns for a request; an unknown column falls back to the default, and ties go by ``tie``."""
    column = sort_by if sort_by in set(allowed) else default
    by = F.col(column).desc_nulls_last() if (direction or "").lower() == "desc" else F.col(column).asc_nulls_first()
    return [by] if column == tie else [by, F.col(tie).asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, from 1; numbers below 1 give the first."""
    return df.orderBy(*order).offset(max(0, (number - 1) * size)).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows, and pages, at least 1."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def top_of_group(df: DataFrame, group: Iterable[str], order: Iterable[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


#: Ranges of the first order column in which rows are ranked.
RANGES = 256


def stride_sample(df: DataFrame, order: Sequence[str], total: int, wanted: int) -> DataFrame:
    """Every ``max(1, total // wanted)``-th row in ascending order, from the first: representative rows of a report.

    The first of the ``order`` columns is a number. Rows are ranked within ranges of it and the ranges' counts are
    summed up, so that no task sorts the whole table.
    """
    step, key = max(1, total // max(1, wanted)), F.col(order[0]).cast("double")
    bounds = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000).alias("__bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < key))).drop("__bounds")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")))
    within = Window.partitionBy("__range").orderBy(*order)
    ranked = placed.withColumn("__n", F.row_number().over(within) - 1).join(starts, "__range").withColumn("__n", F.col("__n") + F.col("__start"))
    return ranked.filter(F.col("__n") % step == 0).orderBy("__n").limit(wanted).drop("__n", "__range", "__start")
