"""Sharding by proportional stratified interleaving, in DataFrame functions only.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is its rank,
less the source's own random offset, over the source's rows. Sorted by fractional rank, every stretch of
the table has each source in its share, and cuts into equal stretches give shards that match the mixture,
with counts at most one apart (law ``rows``).

A source may hold any share of the rows. Ranks come from cells of a few hundred rows (ranges of the hash)
and the cells' counts; places along the fractional rank come from bins in the same way. No task sees a
whole source or the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name, row_hash, seeded_hash, small, whole_row

SHARDS = 8
SEED = "shard-1"
#: Rows in a cell or bin, at least, and cells of a source or bins of the table, about, at most.
CELL_ROWS, MOST_CELLS = 256, 8192


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Deal all rows of ``docs`` (doc_id, source and others) into ``shards`` shards.

    Returns one row per row: ``row`` (the input row as a struct), doc_id, shard (from 0) and slot (the
    row's place within its shard, gapless from 0, in the interleaved order). A null source is a source of
    its own. Rows with the same doc_id are ordered by their content, and rows without one are dealt by it;
    equal rows are interchangeable. Input columns may have any names: they are read from ``row``. An empty table
    gives an empty result; with fewer rows than shards some shards stay empty.
    """
    base = (
        docs.select(whole_row(docs).alias("row"), name("doc_id").alias("doc_id"), name("source").alias("source"), row_hash(docs).alias("tie"))
        .select("row", "doc_id", "tie", F.col("source").isNull().alias("src_null"), F.coalesce("source", F.lit("")).alias("src"), seeded_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("tie")))).alias("h"))
    )
    key = ["src_null", "src"]
    rows_in_cell = F.greatest(F.lit(CELL_ROWS), F.ceil(F.col("n") / MOST_CELLS))
    cells_of = F.ceil(F.col("n") / rows_in_cell)
    sources = checkpointed(base.groupBy(*key).agg(F.count("*").alias("n")).withColumn("cells", cells_of))
    cell = F.expr("shiftright(h * cells, 32)").alias("cell")
    known = small(sources)
    put = base.join(known, key).withColumn("cell", cell)
    cells = base.select(*key, "h").join(known, key).groupBy(*key, "n", cell).agg(F.count("*").alias("rows"))
    along = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, "n", "cell", "rows", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("start"))
    within = Window.partitionBy(*key, "cell").orderBy("h", "doc_id", "tie")
    offset = seeded_hash(seed, F.col("src")) / F.lit(2.0**32)
    part = ((F.col("start") + F.col("rank")) - offset) / F.col("n")

    total = sources.agg(F.sum("n").alias("total")).withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("total") / F.greatest(F.lit(CELL_ROWS), F.ceil(F.col("total") / MOST_CELLS)))))
    bin_of = F.least(F.floor(F.col("part") * F.col("bins")), F.col("bins") - 1).alias("bin")
    # The parts of a cell follow from its start and its count, so the bins are counted without ranking rows again.
    steps = cells.select(*key, "n", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("rank"))
    bins = steps.select(part.alias("part")).join(F.broadcast(total)).groupBy(bin_of).agg(F.count("*").alias("rows"))
    along = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("bin_start"))

    ranked = put.withColumn("rank", F.row_number().over(within)).join(cells.select(*key, "cell", "start"), [*key, "cell"])
    placed = ranked.select("row", "doc_id", *key, part.alias("part")).join(F.broadcast(total)).withColumn("bin", bin_of)
    within = Window.partitionBy("bin").orderBy("part", "src_null", "src")
    placed = placed.withColumn("rank", F.row_number().over(within)).join(bins, "bin")
    place = F.col("bin_start") + F.col("rank") - 1
    dealt = placed.select("row", "doc_id", place.alias("place"), F.expr(f"({shards} * (bin_start + rank - 1)) div total").cast("int").alias("shard"), "total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return dealt.select("row", "doc_id", "shard", (F.col("place") - first).alias("slot"))


SHARD_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
         source IS NULL AS src_null, coalesce(source, '') AS src,
         ('0x' || substr(md5('shard-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
crc_table AS (
  WITH RECURSIVE r AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM r WHERE k < 8)
  SELECT list(c ORDER BY i) AS t FROM r WHERE k = 8),
summed AS (
  SELECT base.* EXCLUDE (bytes),
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32
  FROM base, crc_table),
parts AS (
  SELECT *, (row_number() OVER (PARTITION BY src_null, src ORDER BY h, doc_id)
             - ('0x' || substr(md5('shard-1:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY src_null, src) AS part
  FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY part, src_null, src) - 1 AS place, count(*) OVER () AS total FROM parts)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((8 * place) // total)::INTEGER AS shard,
       place - (((8 * place) // total) * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
