"""Rows dealt out over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many even parts as a shuffle has, for long work on each row.

    A small file is read by one task, and one of few row groups by few, however much work its rows are.
    With keys, rows of equal keys stay together, as a join by them wants it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
