"""Tables that change: upserts, first-write-wins, overlays, immutable versions, leases (DM01-DM17)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: Iterable[str]) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new, list(key), "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Iterable[str]) -> DataFrame:
    """New rows whose key is taken are ignored."""
    return old.unionByName(new.join(old, list(key), "left_anti"))


def review_overlay(rows: DataFrame, reviews: DataFrame, key: str, status: str = "final_status") -> DataFrame:
    """Rows with the reviewers' marks, notes and, where given, another status."""
    r = reviews.select(key, F.lit(True).alias("__reviewed"), F.col("notes").alias("__notes"), F.col("status").alias("__status"))
    out = rows.join(r, key, "left")
    return out.withColumns({"reviewed_by_user": F.coalesce("__reviewed", F.lit(False)), "user_notes": F.coalesce("__notes", F.lit("")), status: F.coalesce(F.nullif("__status", F.lit("")), status)}).drop("__reviewed", "__notes", "__status")


def versions(df: DataFrame, group: str, content: Column, order: Iterable[str]) -> DataFrame:
    """Version numbers from 1 for each group: equal content keeps the version it got first."""
    hashed = df.withColumn("content_hash", content)
    first = hashed.groupBy(group, "content_hash").agg(F.min(F.struct(*order)).alias("__at"))
    numbered = first.withColumn("version", F.row_number().over(Window.partitionBy(group).orderBy("__at"))).drop("__at")
    return hashed.join(numbered, [group, "content_hash"])


def append_versions(existing: DataFrame, new: DataFrame, group: str, content_hash: str = "content_hash") -> DataFrame:
    """Existing versions and, after each group's greatest, the new contents that it does not have."""
    fresh = new.join(existing, [group, content_hash], "left_anti")
    top = existing.groupBy(group).agg(F.max("version").alias("__top"))
    numbered = fresh.join(top, group, "left").withColumn("version", F.coalesce("__top", F.lit(0)) + F.row_number().over(Window.partitionBy(group).orderBy(content_hash))).drop("__top")
    return existing.unionByName(numbered, allowMissingColumns=True)


def lease_state(heartbeat: Column, as_of: Column, seconds: int = 60) -> Column:
    """INTERRUPTED once a lease has run out at ``as_of``, else ACTIVE."""
    return F.when(heartbeat + F.expr(f"interval {int(seconds)} seconds") <= as_of, "INTERRUPTED").otherwise("ACTIVE")


def terminal_violations(old: DataFrame, new: DataFrame, key: str, status: str, terminal: Iterable[str], content: str) -> DataFrame:
    """New rows that would change a run in a terminal state; an identical rewrite is none."""
    done = old.filter(F.col(status).isin(list(terminal))).select(key, F.col(content).alias("__old"))
    return new.join(done, key).filter(F.col(content) != F.col("__old")).drop("__old")


def bound_approvals(approvals: DataFrame, requests: DataFrame, key: str, hashes: Iterable[str], as_of: Column) -> DataFrame:
    """Requests with an approval of the same key and hashes that has neither expired nor been revoked."""
    ok = approvals.filter((F.col("expires_at") > as_of) & ~F.coalesce(F.col("revoked"), F.lit(False)))
    return requests.join(ok.select(key, *hashes), [key, *hashes], "left_semi")


def guarded_refresh(old: DataFrame, new: DataFrame, fewer_than: int = 800, forced: bool = False) -> DataFrame:
    """The new rows in place of the old ones, if those are few or it is forced; else the old ones as they are."""
    return new if forced or old.limit(fewer_than).count() < fewer_than else old
