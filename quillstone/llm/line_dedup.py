"""Line deduplication over sharded cuckoo filters and exact reference counts, with deletion of documents.

A line's key is 128 bits of its stripped, lower-cased text; among 10^12 different lines two have the same
once in 10^15 tables. The state of an index is three tables:

* ``refs`` (k1, k2, doc_id): which document holds which key;
* ``counts`` (k1, k2, n, first, last, again): for each insertion and key, how many documents hold it, and the
  first and last of them; ``again`` tells that an earlier row has the same key;
* ``filters`` (shard, filter): a cuckoo filter of each shard's keys.

Inserting documents asks the filters first, and only these: keys that they do not know are appended as new,
and nothing is looked up for them. Keys that they may know are looked up in the counts; those that are there
are appended with ``again``, the few others are new as well and go into the filters. Reading merges the rows
of the keys that came again and takes the others as they are, so that a key the filters missed would lose its
earlier count: what they answer decides. Deleting documents takes their references away, counts the keys
concerned anew and takes keys without references out of counts and filters, after which the index is as if
the documents had never been there.

Shards follow the hash of the key, so a line that every document holds is one row in one of them; counting
combines before the shuffle. When the keys outgrow the shards, there are twice as many, and their filters are
built anew from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name, ordered_id
from quillstone.llm.cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
#: Code points of a key, at least.
MIN_KEY = 10
#: Keys of a shard while shards are few, and at most.
SHARD_KEYS, MOST_KEYS, MANY_SHARDS = 2048, 1_000_000, 8192
#: Room of a new filter, as a multiple of the keys that it begins with: another insertion as large fits in.
SPARE = 2.5
#: Insertions that a whole table is dealt to.
BATCHES = 2
KEY = ["k1", "k2"]
COUNTS = "k1 long, k2 long, n long, first long, last long, again boolean"
FILTERS = "shard long, filter binary"


def line_key(line: bytes) -> tuple[int, int] | None:
    """The key of a line, or None for a short one."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_KEY or (len(key) < 4 * MIN_KEY and len(key.decode()) < MIN_KEY):
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (h >> 127 << 64), (h & (1 << 64) - 1) - ((h >> 63 & 1) << 64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, k1, k2 = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            keys = {line_key(line) for line in (text.as_py() or b"").split(b"\n")} - {None}
            ids += [doc_id] * len(keys)
            k1 += [k[0] for k in keys]
            k2 += [k[1] for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1, k2, ids)], names=["k1", "k2", "doc_id"])


def postings(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id) for the distinct keys of every row."""
    slim = docs.select(ordered_id(name("doc_id"), name("text")).alias("doc_id"), name("text").alias("text"))
    return slim.mapInArrow(_postings, "k1 long, k2 long, doc_id long")


@dataclass
class LineIndex:
    """An index over lines. ``insert`` and ``delete`` give new ones; no table is changed in place."""

    shards: int
    keys: int
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 1) -> LineIndex:
        """An index of nothing."""
        return cls(shards, 0, spark.createDataFrame([], "k1 long, k2 long, doc_id long"), spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. What a document already holds is counted once."""
        return self.insert_postings(postings(docs).distinct())

    def insert_postings(self, found: DataFrame, known: bool = True) -> LineIndex:
        """Add distinct (k1, k2, doc_id). ``known``: some may be there already; else all documents are new."""
        new = found.select(*KEY, "doc_id")
        if known:
            new = checkpointed(new.join(self.refs, [*KEY, "doc_id"], "left_anti").select(*KEY, "doc_id") if self.keys else new)
        batch = checkpointed(new.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        added = batch.count()
        before = self._for(self.keys + added)
        by_shard = batch.withColumn("shard", before._shard()).groupBy("shard").cogroup(before.filters.groupBy("shard"))
        asked = checkpointed(by_shard.applyInArrow(_ask_and_add, "k1 long, k2 long, n long, first long, last long, seen boolean, shard long, filter binary"))
        fresh = asked.filter("not seen").select(*batch.columns, F.lit(False).alias("again"))
        perhaps = asked.filter("seen").select(batch.columns)
        filters = asked.filter("k1 is null").select("shard", "filter")
        filters = filters.unionByName(before.filters.join(filters, "shard", "left_anti"))
        rows, again = fresh, 0
        if self.keys:
            # One row of a key, its first, has again = false.
            there = self.counts.filter("not again").select(*KEY, F.lit(True).alias("again"))
            perhaps = checkpointed(perhaps.join(there, KEY, "left").withColumn("again", F.coalesce("again", F.lit(False))))
            again = perhaps.filter("again").count()
            mistaken = perhaps.filter("not again")
            if not mistaken.isEmpty():
                filters = mistaken.withColumn("shard", before._shard()).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_add, FILTERS)
            rows = fresh.unionByName(perhaps)
        counts = self.counts.unionByName(rows)
        after = replace(before, keys=self.keys + added - again, refs=self.refs.unionByName(new), counts=counts, filters=checkpointed(filters))
        return after._with_full_rebuilt()

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents (doc_id, text) out again; without doc_id a document is known by its text."""
        ids = checkpointed(docs.select(ordered_id(name("doc_id"), name("text")).alias("doc_id")).distinct())
        refs = checkpointed(self.refs.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"))
        touched = checkpointed(self.refs.join(ids, "doc_id", "left_semi").select(*KEY).distinct())
        left = checkpointed(refs.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.lit(False).alias("again")))
        counts = checkpointed(self.counts.join(touched, KEY, "left_anti").select(left.columns).unionByName(left))
        gone = checkpointed(touched.join(left, KEY, "left_anti").withColumn("shard", self._shard()))
        filters = checkpointed(gone.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_remove, FILTERS))
        return replace(self, keys=self.keys - gone.count(), refs=refs, counts=counts, filters=filters)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Which of the ``keys`` (k1, k2) the filters may know: a column ``seen``. For tests and monitoring."""
        asked = keys.select(*KEY, self._shard().alias("shard"))
        return asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_ask, "k1 long, k2 long, seen boolean")

    def totals(self) -> DataFrame:
        """(k1, k2, n, first, last): one row for each key. Only keys that came again have rows to merge."""
        again = checkpointed(self.counts.filter("again").select(*KEY).distinct())
        merged = self.counts.join(again, KEY, "left_semi").groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        return self.counts.join(again, KEY, "left_anti").drop("again").unionByName(merged)

    def repeated(self) -> DataFrame:
        """(k1, k2, first) for the keys of at least two documents."""
        return self.totals().filter("first < last").select(*KEY, "first")

    def _shard(self):
        return F.pmod("k1", F.lit(self.shards)).cast("long")

    def _for(self, keys: int) -> LineIndex:
        """The index with shards enough for so many keys: doubled, and their filters built anew, as often as needed."""
        shards = self.shards
        while keys > shards * (SHARD_KEYS if shards < MANY_SHARDS else MOST_KEYS):
            shards *= 2
        if shards == self.shards or not self.keys:
            return replace(self, shards=shards)
        more = replace(self, shards=shards)
        return replace(more, filters=checkpointed(more._built(self.counts)))

    def _built(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KEY).distinct().withColumn("shard", self._shard()).groupBy("shard").applyInArrow(_build, FILTERS)

    def _with_full_rebuilt(self) -> LineIndex:
        """Filters that had no room are null; they are built anew, larger, from the exact keys."""
        full = self.filters.filter("filter is null").select("shard")
        if full.isEmpty():
            return self
        rows = self.counts.withColumn("shard", self._shard()).join(full, "shard", "left_semi")
        return replace(self, filters=checkpointed(self.filters.filter("filter is not null").unionByName(self._built(rows))))


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("k1").to_numpy(), table.column("k2").to_numpy()


def _filter_of(state: pa.Table) -> CuckooFilter | None:
    return CuckooFilter.from_bytes(state.column("filter")[0].as_py()) if state.num_rows and state.column("filter")[0].is_valid else None


def _state(shard: int, data: bytes | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([data], pa.binary())})


def _ask_and_add(batch: pa.Table, state: pa.Table) -> pa.Table:
    """One shard: which keys its filter may know; the others go into it. Its filter is the last row, null if full."""
    if not batch.num_rows:
        return _asked(batch, np.empty(0, bool), state.column("shard")[0].as_py(), state.column("filter")[0].as_py())
    k1, k2 = _keys(batch)
    f = _filter_of(state)
    if f is None:
        seen, data = np.zeros(k1.size, bool), CuckooFilter.of(k1, k2, SPARE).to_bytes()
    else:
        seen = f.contains(k1, k2)
        data = f.to_bytes() if f.insert(k1[~seen], k2[~seen]) else None
    return _asked(batch, seen, batch.column("shard")[0].as_py(), data)


def _asked(batch: pa.Table, seen: np.ndarray, shard: int, data: bytes | None) -> pa.Table:
    n = batch.num_rows
    columns = {c: pa.concat_arrays([*batch.column(c).chunks, pa.nulls(1, pa.int64())]) for c in ("k1", "k2", "n", "first", "last")}
    return pa.table(columns | {"seen": pa.array([*seen.tolist(), None], pa.bool_()), "shard": pa.array([shard] * (n + 1), pa.int64()), "filter": pa.array([None] * n + [data], pa.binary())})


def _add(keys: pa.Table, state: pa.Table) -> pa.Table:
    """Keys that are new though the filter seemed to know them go into it; null if it is full."""
    f = _filter_of(state)
    if not keys.num_rows or f is None:
        return _state(state.column("shard")[0].as_py(), state.column("filter")[0].as_py())
    return _state(keys.column("shard")[0].as_py(), f.to_bytes() if f.insert(*_keys(keys)) else None)


def _ask(batch: pa.Table, state: pa.Table) -> pa.Table:
    f = _filter_of(state)
    k1, k2 = _keys(batch)
    return pa.table({"k1": batch.column("k1"), "k2": batch.column("k2"), "seen": pa.array(f.contains(k1, k2) if f else np.zeros(k1.size, bool))})


def _remove(gone: pa.Table, state: pa.Table) -> pa.Table:
    f = _filter_of(state)
    if f is not None and gone.num_rows:
        f.delete(*_keys(gone))
        return _state(state.column("shard")[0].as_py(), f.to_bytes())
    return state.select(["shard", "filter"])


def _build(keys: pa.Table) -> pa.Table:
    return _state(keys.column("shard")[0].as_py(), CuckooFilter.of(*_keys(keys)).to_bytes())


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, dropped keys) to rows (doc_id, n_lines, n_dropped, text), a bounded number of bytes at a time."""
    out: list[tuple] = []
    held = 0

    def rows() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    for batch in batches:
        for doc_id, text, drop in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            lines = kept = (text.as_py() or b"").split(b"\n")
            if drop.is_valid:
                keys = {(d["k1"], d["k2"]) for d in drop.as_py()}
                kept = [x for x in lines if line_key(x) not in keys]
            left = b"\n".join(kept)
            out.append((doc_id, len(lines), len(lines) - len(kept), left))
            held += len(left)
            if held > 64_000_000 or len(out) == 1000:
                yield rows()
                out.clear()
                held = 0
    if out:
        yield rows()


def drop_lines(docs: DataFrame, index: LineIndex, found: DataFrame | None = None) -> DataFrame:
    """Documents without the lines that an earlier document of ``index`` holds: doc_id, n_lines, n_dropped, text.

    A key of at least two documents loses its lines in all but the one with the smallest doc_id; lines with
    keys of under 10 code points stay. A null or empty text is one empty line. Rows with the same doc_id
    count as one document and each keep what it keeps. Rows without doc_id come after all others, in the order
    of a hash of their text, those with equal texts as one document. Other columns, whatever their names, are
    not read. An empty table gives an empty result. ``found`` are the postings of ``docs`` where they are known.
    """
    # Read back, both sides of the join are plain exchanges, which adaptive execution splits at a hot key.
    repeated = (postings(docs) if found is None else found).join(checkpointed(index.repeated()), KEY).filter("doc_id <> first")
    drops = repeated.groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct(*KEY)).alias("keys"))
    rows = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"), ordered_id(name("doc_id"), name("text")).alias("own"))
    return rows.join(drops, "own", "left").select("doc_id", "text", "keys").mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``drop_lines`` for a whole table, by an index into which it is inserted in ``batches`` of documents."""
    found = checkpointed(postings(docs).distinct())
    # Shards enough for all keys from the start: there are no more keys than postings.
    index = LineIndex.empty(docs.sparkSession)._for(found.count())
    for k in range(batches):
        index = index.insert_postings(found.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), known=False)
    return drop_lines(docs, index, found)


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT lines.*, repeated.first IS NOT NULL AND lines.doc_id <> repeated.first AS dropped FROM lines LEFT JOIN repeated USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
