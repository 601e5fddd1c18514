"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected ``target / source_size`` times. Along one order of the source
those expectations are summed up, one random offset is added, and a document is taken once per integer
boundary that its step crosses. The order runs by size class and, within one, by a seeded hash of
doc_id: neighbours have like sizes, so that the words taken stay near the target.

A source may hold any share of the rows. No task sees a whole source: rows are ranked within cells of a
few hundred rows (source, size class, range of the hash), and the cells' counts, not the rows, are summed
up along the source. Cells grow only where a source has so many rows that there would be too many cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name, row_hash, seeded_hash, small, whole_row, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Rows in a cell, at least, and cells of one size class of a source, about, at most.
CELL_ROWS, MOST_CELLS = 256, 8192


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Give each row of ``sources`` (src_null, src, source_size) its ``target``.

    Weights repeat along the sources by code point, null last. ``share`` of all words is dealt out by
    weight; no target exceeds ``cap`` times its source, and what is cut goes to the others by weight.
    With the sources by cap over weight, the first level of words per unit of weight at which the next
    source stays within its cap is the level for all.
    """
    by_name = Window.partitionBy("one").orderBy("src_null", "src")
    by_room = Window.partitionBy("one").orderBy(F.col("cap") / F.col("weight"), "place")
    before, everyone = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("one")
    s = (
        sources.withColumn("one", F.lit(1))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("k", F.row_number().over(by_room))
        .withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everyone) * share - F.col("gone")) / F.col("left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("k"))).over(everyone))
    )
    return s.select("src_null", "src", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source and others) is taken.

    Returns one row per row: ``row`` (the input row as a struct), doc_id, source, size (words of the text;
    null has 0), source_size, target, copies, taken (copies times size). A null source is a source of its
    own. Sources without words have target 0 and give nothing; documents without words are taken like the
    others and add no words. Rows with the same doc_id are ranked apart by their content, and rows without one
    are dealt by it; equal rows are interchangeable. An input column may have any name: those of the result are
    taken from ``row``. An empty table gives an empty plan. Reruns give the same rows. The sources themselves,
    and their size classes, are summed up in one task, so they should not be more than some millions.
    """
    size = F.col("size")
    bits = F.length(F.bin(size))
    size_class = F.when(size < 16, size).otherwise(bits * 16 + F.expr("shiftright(size, int(length(bin(size)) - 4))"))
    base = (
        docs.select(whole_row(docs).alias("row"), name("doc_id").alias("doc_id"), name("source").alias("source"), word_count(name("text")).alias("size"), row_hash(docs).alias("tie"))
        .withColumn("src_null", F.col("source").isNull())
        .withColumn("src", F.coalesce("source", F.lit("")))
        .withColumn("class", size_class.cast("int"))
        .withColumn("h", seeded_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("tie")))))
    )
    key = ["src_null", "src"]
    # Words are counted once for all the statistics, and once more for the rows that are dealt with them.
    sized = checkpointed(base.select(*key, "class", "h", "size"))
    classes = checkpointed(sized.groupBy(*key, "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    along = Window.partitionBy(*key).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    rows_in_cell = F.greatest(F.lit(CELL_ROWS), F.ceil(F.col("n") / MOST_CELLS))
    classes = (
        classes.withColumn("class_start", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .withColumn("cells", F.ceil(F.col("n") / rows_in_cell))
        .join(targets(classes.groupBy(*key).agg(F.sum("words").alias("source_size")), weights, share, cap), key)
    )
    # Sources times size classes: few rows, counted before they are broadcast.
    classes = small(checkpointed(classes.select(*key, "class", "cells", "class_start", "source_size", "target")))
    cell_of = F.expr("shiftright(h * cells, 32)").alias("cell")
    put = base.join(classes, [*key, "class"]).withColumn("cell", cell_of)
    cells = sized.select(*key, "class", "h").join(classes, [*key, "class"]).withColumn("cell", cell_of)
    cells = cells.groupBy(*key, "class", "cell").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*key, "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, "class", "cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy(*key, "class", "cell").orderBy("h", "doc_id", "size", "tie")
    ranked = put.withColumn("rank", F.row_number().over(within)).join(cells, [*key, "class", "cell"])
    place = F.col("class_start") + F.col("cell_start") + F.col("rank")
    offset = seeded_hash(seed, F.col("src")) / F.lit(2.0**32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)
    copies = F.least(copies, F.lit(cap).cast("long"))
    return ranked.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``plan_mix`` takes it, with its own columns."""
    plan = plan_mix(docs, **options).filter("copies > 0")
    return plan.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         source IS NULL AS src_null, coalesce(source, '') AS src,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
sources AS (SELECT src_null, src, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
placed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY src_null, src) - 1) % 3] AS weight, 2 * source_size AS cap FROM sources),
level AS (
  SELECT *, row_number() OVER w AS k,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lam
  FROM placed WINDOW w AS (ORDER BY cap / weight, src_null, src)),
chosen AS (SELECT arg_min(lam, k) AS lam FROM level WHERE lam * weight <= cap),
target AS (SELECT src_null, src, source_size, least(cap::DOUBLE, chosen.lam * weight) AS target FROM level, chosen),
ranked AS (
  SELECT base.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY src_null, src ORDER BY
           CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 4)) END, h, doc_id, size) AS place
  FROM base JOIN target USING (src_null, src))
SELECT doc_id, size, source_size, target,
       least(floor(rate * place + u)::BIGINT - floor(rate * (place - 1) + u)::BIGINT, 2) AS copies,
       least(floor(rate * place + u)::BIGINT - floor(rate * (place - 1) + u)::BIGINT, 2) * size AS taken
FROM ranked
"""
