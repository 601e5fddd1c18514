"""Jobs of a ledger as tables: claims by one worker, heartbeats of the owner, requests to cancel (DM09, DM11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run that no request changes any more, and states in which it already is to stop.
TERMINAL = ("COMPLETED", "FAILED", "BLOCKED", "TIMED_OUT", "INTERRUPTED")
STOPPING = ("CANCELLED", "CANCEL_REQUESTED")


def claimed(jobs: DataFrame, requests: DataFrame, lease: str) -> DataFrame:
    """``jobs`` (run_id, status) with worker_id, claimed_at, heartbeat_at and lease_expiry.

    Of the ``requests`` (run_id, worker_id, at) for a QUEUED job the earliest wins, of equal times the least
    worker; the others find the job taken. Jobs in another state, or without a request, stay as they are.
    """
    first = requests.groupBy("run_id").agg(F.min(F.struct("at", "worker_id")).alias("first"))
    won = (F.col("status") == "QUEUED") & F.col("first").isNotNull()
    only = lambda c: F.when(won, c)
    at = F.col("first.at")
    return jobs.join(first, "run_id", "left").select("run_id", F.when(won, "CLAIMED").otherwise(F.col("status")).alias("status"), only(F.col("first.worker_id")).alias("worker_id"), only(at).alias("claimed_at"), only(at).alias("heartbeat_at"), only(at + F.expr(lease)).alias("lease_expiry"))


def beaten(jobs: DataFrame, beats: DataFrame, lease: str) -> DataFrame:
    """Claimed ``jobs`` after the ``beats`` (run_id, worker_id, at): the owner's latest one sets beat and lease."""
    latest = beats.groupBy("run_id", "worker_id").agg(F.max("at").alias("beat"))
    alive = (F.col("status") == "CLAIMED") & F.col("beat").isNotNull()
    later = lambda new, old: F.when(alive, new).otherwise(F.col(old)).alias(old)
    return jobs.join(latest, ["run_id", "worker_id"], "left").select("run_id", "status", "worker_id", "claimed_at", later(F.col("beat"), "heartbeat_at"), later(F.col("beat") + F.expr(lease), "lease_expiry"))


def cancel(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested run_id what comes of it (outcome) and the run's status after it."""
    s = F.col("status")
    outcome: Column = F.when(s.isNull(), "UNKNOWN_RUN").when(s.isin(*STOPPING), "UNCHANGED").when(s.isin(*TERMINAL), "REFUSED").otherwise("REQUESTED")
    asked = requests.select("run_id").distinct().join(runs, "run_id", "left").withColumn("outcome", outcome)
    return asked.select("run_id", "outcome", F.when(F.col("outcome") == "REQUESTED", "CANCEL_REQUESTED").otherwise(s).alias("status"))
