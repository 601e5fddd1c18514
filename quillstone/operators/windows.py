"""Ordered de-duplication, latest rows, sliding excerpts, transitions (WN01-WN15)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Iterable[str | Column], order: Iterable[Column]) -> DataFrame:
    """The first row of each key in encounter order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest(df: DataFrame, key: Iterable[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; the greater tie value wins. Combines before the shuffle."""
    keys = list(key)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def keep_last_at_first(df: DataFrame, key: Iterable[str], order: str) -> DataFrame:
    """One row for each key: the values of its last row at the position of its first."""
    keys = list(key)
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"), F.min(order).alias(order)).select(*keys, order, "__row.*")


def fan_out(df: DataFrame, fingerprint: Column, computed: DataFrame, key: str) -> DataFrame:
    """Give every row what was computed once for its fingerprint."""
    return df.withColumn(key, fingerprint).join(computed, key, "left")


def excerpt(df: DataFrame, doc: str, line: str, text: str, before: int = 2, after: int = 3) -> DataFrame:
    """Each line with the lines around it, joined by one space."""
    w = Window.partitionBy(doc).orderBy(line).rowsBetween(-before, after)
    return df.withColumn("excerpt", F.array_join(F.collect_list(F.col(text)).over(w), " "))


def transitions(df: DataFrame, entity: str, order: Iterable[Column], state: str) -> DataFrame:
    """Each state with the one before it of the same entity; the first has null."""
    return df.withColumn("previous", F.lag(state).over(Window.partitionBy(entity).orderBy(*order)))


def illegal(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves (previous, state) that the table of allowed ones does not have; staying in a state is allowed."""
    moves = moves.filter("previous is not null and previous <> state")
    return moves.join(allowed, ["previous", "state"], "left_anti")


def claimed_once(df: DataFrame, doc: str, identifier: str, order: str) -> DataFrame:
    """Mark a document's later claims of an identifier that an earlier row of it has; '' claims nothing."""
    w = Window.partitionBy(doc, F.lower(identifier)).orderBy(order)
    return df.withColumn("duplicate", (F.coalesce(F.col(identifier), F.lit("")) != "") & (F.row_number().over(w) > 1))


def target_rank(df: DataFrame, group: Iterable[str], readiness: str, missing: str, score: str, tie: str) -> DataFrame:
    """Rank eligible targets: readiness, then fewest missing, then highest score, then id."""
    w = Window.partitionBy(*group).orderBy(F.col(readiness), F.col(missing), F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w))
