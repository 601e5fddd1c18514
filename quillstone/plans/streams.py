"""Queries that run as streams over the event log (STR01-STR05 and extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.registry import query
from quillstone.plans.tables import table
from quillstone.streaming import ledger


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a stream of one folder's files."""
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


@query("str01_stream_counts", "SELECT event_type, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last_event FROM events GROUP BY 1")
def str01(spark, sf):
    counts = _stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return ledger.run_once(counts)


@query("ext_stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ext_stream_tumbling(spark, sf):
    """Extension: daily windows of event time, as a stream."""
    timed = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ledger.run_once(ledger.tumbling(timed, "ts", "1 day", "10 minutes", "event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str05_state_fold")
def str05(spark, sf):
    """Last state and moves of every user, folded by a stream that keeps state."""
    allowed = {a: {b for b in ("cart", "click", "login", "logout", "purchase", "search", "signup", "view") if a < b} for a in ("cart", "click", "login", "logout", "purchase", "search", "signup", "view")}
    folded = ledger.fold(_stream(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id", allowed)
    return ledger.run_once(folded, "update")


@query("str03_lease_events", """
WITH b AS (SELECT user_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS next FROM (SELECT DISTINCT user_id, ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS at FROM events)
SELECT user_id, CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 'CLAIMED' ELSE 'RENEWED' END AS event, ts AS at FROM b
UNION ALL SELECT user_id, 'EXPIRED', ts + INTERVAL 6 HOUR FROM b, mark WHERE next >= ts + INTERVAL 6 HOUR OR next IS NULL AND ts + INTERVAL 6 HOUR < mark.at""")
def str03(spark, sf):
    """Leases of six hours that every user's events hold: claims, renewals, and what had expired when the stream ended."""
    timed = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ledger.run_once(ledger.lease_events(timed, "ts", "user_id", 6 * 3600), "append")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))
