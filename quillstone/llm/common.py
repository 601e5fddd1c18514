"""What the operators of this subpackage share: words, seeded hashes, null-safe keys, checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space. Python's bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def name(column: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(seed: str, value: Column) -> Column:
    """32 bits as a long, the same in every engine that has md5: its first 8 hex digits; null counts as ''."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64 bits over all columns that can be hashed: tells rows with the same id apart in an order."""
    kept = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[name(c) for c in kept]) if kept else F.lit(0).cast("long")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[name(c) for c in df.columns])


def filtered(df: DataFrame, keep) -> DataFrame:
    """The rows of ``df`` that an Arrow function leaves: it gets batches of ``row`` and ``text`` and returns those of ``row``.

    As a struct, a row may have columns of any names.
    """
    kept = df.select(whole_row(df).alias("row"), name("text").alias("text")).mapInArrow(keep, T.StructType([T.StructField("row", df.schema)]))
    return kept.select("row.*")


#: Ids from here on stand for the texts of rows without doc_id.
NO_ID = 2**62


def ordered_id(doc_id: Column, text: Column) -> Column:
    """doc_id as a long; a row without one gets an id after all others, from a hash of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set for checkpoints.

    Where neither is set, a temporary one is made, on this machine alone, in local mode; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a checkpointed table, at most, with which it is broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table, broadcast if its counted rows allow it; else adaptive execution joins it as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: Longs in the lists of a checkpointed table, at most, with which it is broadcast.
BROADCAST_LONGS = 1_000_000


def small_lists(df: DataFrame, lists: str, longs: int = BROADCAST_LONGS) -> DataFrame:
    """Like ``small``, for a table of rows with lists of longs; each row counts as one more."""
    total = df.agg(F.sum(F.size(lists) + 1)).first()[0]
    return F.broadcast(df) if (total or 0) <= longs else df
