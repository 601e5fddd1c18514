"""Near-duplicate documents by one-permutation MinHash, with every link confirmed on full shingle sets.

1. A document's set holds the 64-bit hashes of its distinct 5-word shingles. The hash range is cut into
   bins; the least hash of each bin is the sketch, and an empty bin takes the value of the first filled
   bin in its own fixed random sequence (optimal densification).
2. Documents with equal sets form a class, which goes on as one row.
3. Bands of the sketch are bucket keys. A bucket is a star with its smallest member as its centre, and the
   first round compares each document with the least of its buckets' centres, one edge for each document.
   Confirmed links are joined to components.
4. A bucket whose members are all of one component is done. In the second round the centres of the others are
   the members outside of their largest component, which are compared with all the rest: the pairs are a
   bucket's odd members times its size, and near copies of one text, however many, cost one star.
5. Buckets in which most are unlike one another have too many odd members for stars (more than ODD). They make
   groups, and within a group all pairs are compared but those within its largest component, by pairs of
   blocks, so that no task meets more than two blocks.
6. Every pair of a bucket has then been compared, or is joined by links of others. The components are the
   result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, checkpointed, name, row_hash, whole_row
from quillstone.llm.graph import components
from quillstone.llm.words import WordHashes, mixed

SHINGLE = 5
#: Links need 100 * intersection >= SIMILARITY * union. A pair at the limit shares no band once in 300,000.
SIMILARITY = 75
BANDS, ROWS = 64, 6
#: Members of a star that go to one group of rows, about, each with the star's centres.
BLOCK = 256
#: Members outside a bucket's largest component up to which they are centres of stars.
ODD = 64
#: Documents in a block of a group of unlike documents, about.
GROUP_BLOCK = 128
SEED = 20_011


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle; none have none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    powers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    if n < SHINGLE:
        return mixed((w * powers[:n]).sum(keepdims=True) + np.uint64(n))
    h = w[: n - 4] * powers[0]
    for i in range(1, SHINGLE):
        h += w[i : n - 4 + i] * powers[i]
    h = np.sort(mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return shingles((text or b"").lower().split(), hashes)


class Sketcher:
    """Band keys of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.order = rng.permuted(np.tile(np.arange(self.bins, dtype=np.int64), (self.bins, 1)), axis=1)
        self.rank = np.argsort(self.order, axis=1).astype(np.int32)
        self.factors = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(1, 2**63, bands, dtype=np.uint64)

    def sketch(self, members: np.ndarray) -> np.ndarray:
        b = ((members >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        filled = b[first]
        out = np.zeros(self.bins, np.uint64)
        out[filled] = members[first]
        if filled.size < self.bins:
            has = np.zeros(self.bins, bool)
            has[filled] = True
            empty = np.flatnonzero(~has)
            if filled.size < 48:
                donors = filled[self.rank[empty][:, filled].argmin(axis=1)]
            else:
                donors = np.full(empty.size, -1)
                open_, t = np.arange(empty.size), 0
                while open_.size:
                    c = self.order[empty[open_], t]
                    ok = has[c]
                    donors[open_[ok]] = c[ok]
                    open_, t = open_[~ok], t + 1
            out[empty] = out[donors]
        return out

    def keys(self, members: np.ndarray) -> np.ndarray:
        s = self.sketch(members).reshape(self.bands, self.rows)
        return mixed((s * self.factors).sum(axis=1) + self.salts).view(np.int64)


SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, sketcher = WordHashes(), Sketcher()
    none = np.empty(0, np.int64)
    for batch in batches:
        for part in range(0, batch.num_rows, 1000):
            some = batch.slice(part, 1000)
            n, s1, s2, bands = [], [], [], []
            for text in some.column(2).cast(pa.large_binary()):
                s = set_of(text.as_py(), hashes)
                n.append(s.size)
                sums = signature(s)
                s1.append(sums[0])
                s2.append(sums[1])
                bands.append(sketcher.keys(s) if s.size else none)
            offsets = np.concatenate(([0], np.cumsum([x.size for x in bands]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], schema=SIGNATURE)


def signature(members: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on order: equal sets have equal ones."""
    a = mixed(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(members + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def linked_with(centre: np.ndarray, members: np.ndarray, starts: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Which of the members' sets, given one after the other from ``starts`` on, are linked with the centre's."""
    at = np.minimum(np.searchsorted(centre, members), centre.size - 1)
    both = np.add.reduceat((centre[at] == members).astype(np.int64), starts)
    size = np.diff(np.append(starts, members.size))
    return 100 * both >= similarity * (centre.size + size - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (star, block, role, node, text), sorted by the first three, to the confirmed links (a, b).

    A block's centres (role 0) come before its members (role 1), of which only some are held at a time.
    """
    hashes = WordHashes()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, centres, nodes, sets, held = None, [], [], [], 0

    def links() -> pa.RecordBatch:
        members, ids = np.concatenate(sets), np.array(nodes, np.int64)
        starts = np.concatenate(([0], np.cumsum([s.size for s in sets[:-1]], dtype=np.int64)))
        a, b = [], []
        for node, centre in centres:
            to = ids[linked_with(centre, members, starts)]
            to = to[to != node]
            a.append(np.full(to.size, node))
            b.append(to)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], schema=schema)

    for batch in batches:
        star, block, role, node_of = (batch.column(i).to_pylist() for i in range(4))
        for i, text in enumerate(batch.column(4).cast(pa.large_binary())):
            if (star[i], block[i]) != key or held > 2_000_000:
                if nodes:
                    yield links()
                    nodes, sets, held = [], [], 0
                if (star[i], block[i]) != key:
                    key, centres = (star[i], block[i]), []
            s = set_of(text.as_py(), hashes)
            if not s.size:
                continue
            if role[i] == 0:
                centres.append((node_of[i], s))
            else:
                nodes.append(node_of[i])
                sets.append(s)
                held += s.size
    if nodes:
        yield links()


def _stars(members: DataFrame, slim: DataFrame) -> DataFrame:
    """The links (a, b) between the members (rep, n, label, centres: array of these) of stars and their centres.

    Stars with the same centres are one, whatever their buckets. Only members of another component than some
    centre, whose size allows a link, are compared. A star's members are cut into blocks, which bring the centres' texts with them.
    """
    fits = F.exists("centres", lambda c: (c["label"] != F.col("label")) & (100 * F.least(c["n"], F.col("n")) >= SIMILARITY * F.greatest(c["n"], F.col("n"))))
    pairs = checkpointed(members.filter(fits).select(F.transform("centres", lambda c: c["rep"]).alias("star"), "rep").distinct())
    blocks = pairs.groupBy("star").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "star").select(F.xxhash64("star").alias("star"), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(1).alias("role"), F.col("rep").alias("node"))
    centres = blocks.select("star", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(F.xxhash64("star").alias("own"), "block", F.lit(0).alias("role"), F.explode("star").alias("node")).withColumnRenamed("own", "star")
    rows = dealt.unionByName(centres).join(slim, F.col("node") == slim["doc_id"]).select("star", "block", "role", "node", "text")
    return rows.repartition("star", "block").sortWithinPartitions("star", "block", "role").mapInArrow(_confirm, "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (rep and others) with the label of their component; alone, a row is its own."""
    if labels is None:
        return rows.withColumn("label", F.col("rep"))
    return rows.join(labels, rows["rep"] == labels["node"], "left").select(*rows.columns, F.coalesce("label", "rep").alias("label"))


def linked_groups(sets: list[np.ndarray], similarity: int = SIMILARITY) -> np.ndarray:
    """For each set the index of the first set that it is linked with, directly or through others."""
    m = len(sets)
    sizes = np.array([s.size for s in sets], np.int64)
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([0, 0 if 100 * both >= similarity * (sizes.sum() - both) else 1])
    tokens, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    column, owner = place[at[keep]], owner[keep]
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, 4_000_000 // m)
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        block = np.zeros((m, width), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        common += block @ block.T
    both = np.rint(common).astype(np.int64)
    link = 100 * both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        to = np.where(link, label[None, :], m).min(axis=1)
        to = to[to]
        if (to == label).all():
            return label
        label = to


def _confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, lo, hi, node, text), each group's together, to the links that join what is linked in it."""
    hashes = WordHashes()
    key, nodes, sets = None, [], []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links() -> pa.RecordBatch:
        label = linked_groups(sets) if len(sets) > 1 else np.zeros(len(sets), np.int64)
        ids = np.array(nodes, np.int64)
        joined = np.flatnonzero(label != np.arange(label.size))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[joined]]), pa.array(ids[joined])], schema=schema)

    for batch in batches:
        for *k, node, text in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4).cast(pa.large_binary()).to_pylist(), strict=True):
            if k != key:
                if len(sets) > 1:
                    yield links()
                key, nodes, sets = k, [], []
            s = set_of(text, hashes)
            if s.size:
                nodes.append(node)
                sets.append(s)
    if len(sets) > 1:
        yield links()


def _groups(members: DataFrame, slim: DataFrame) -> DataFrame:
    """The links (a, b) within groups of buckets that share members (key, rep, label), found by pairs of blocks.

    Members of a group's largest component have blocks of their own, which are not compared with one another.
    """
    ends = members.groupBy("key").agg(F.min("rep").alias("a"))
    groups = components(members.join(ends, "key").select("a", F.col("rep").alias("b")).filter("a <> b").distinct())
    of = checkpointed(members.select("rep", "label").distinct().join(groups.select(F.col("node").alias("rep"), F.col("label").alias("of")), "rep"))
    sizes = of.groupBy("of", "label").agg(F.count("*").alias("size")).groupBy("of").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.max("size").alias("joined"), F.sum("size").alias("size"))
    blocks = sizes.select("of", "largest", F.ceil(F.col("joined") / GROUP_BLOCK).alias("first"), (F.ceil(F.col("joined") / GROUP_BLOCK) + F.ceil((F.col("size") - F.col("joined")) / GROUP_BLOCK)).alias("blocks"))
    h = F.xxhash64("rep")
    own = F.when(F.col("label") == F.col("largest"), F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("blocks") - F.col("first")))
    placed = of.join(blocks, "of").withColumn("own", own)
    rows = placed.join(slim, F.col("rep") == slim["doc_id"]).select("of", "rep", "text", "own", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.filter("own >= first or other >= first").select("of", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "text")
    return rows.repartition("of", "lo", "hi").sortWithinPartitions("of", "lo", "hi").mapInArrow(_confirm_blocks, "a long, b long").distinct()


def links_of(buckets: DataFrame, slim: DataFrame) -> DataFrame | None:
    """Labels (node, label) of the components that the links within buckets (key, rep, n) join; None without links."""
    one = F.struct("rep", "n", "label")
    rows = buckets.withColumn("label", F.col("rep"))
    least = rows.groupBy("key").agg(F.min(one).alias("least"))
    links = checkpointed(_stars(rows.join(least, "key").groupBy("rep", "n", "label").agg(F.array(F.min("least")).alias("centres")), slim))
    labels = None if links.isEmpty() else components(links)

    rows = _labelled(buckets, labels)
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), (F.sum("size") - F.max("size")).alias("odd"))
    rows = checkpointed(rows.join(sizes.filter("odd > 0"), "key"))
    centres = rows.filter(F.col("odd") <= ODD).filter("label <> largest").groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("centres"))
    found = _stars(rows.filter(F.col("odd") <= ODD).join(centres, "key"), slim)
    unlike = rows.filter(F.col("odd") > ODD)
    if not unlike.isEmpty():
        found = found.unionByName(_groups(unlike, slim))
    found = checkpointed(found)
    return labels if found.isEmpty() else components(links.unionByName(found))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A null or blank text has no shingles and is linked with nothing. ``component_id`` is the smallest
    doc_id reachable, ``kept`` tells whether it is the row's own. Rows with the same doc_id stand for one
    document: links of either are links of both where their texts differ. A row without doc_id takes part
    only in equality of sets: kept is false where a document has its set. Repeated rows are alike; other
    columns, whatever their names, are not read. An empty table gives an empty result. Texts are used whole.
    """
    return _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _grouped(docs: DataFrame) -> DataFrame:
    slim = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"))
    signed = checkpointed(slim.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_signatures, "doc_id long, text_hash long, n long, s1 long, s2 long, bands array<long>"))
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("first"))
    classes = checkpointed(classes.select("s1", "s2", F.col("first.doc_id").alias("rep"), F.col("first.n").alias("n"), F.col("first.bands").alias("bands")))

    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("key")
    labels = links_of(checkpointed(buckets.join(shared, "key").distinct()), slim)
    named = _labelled(classes.select("s1", "s2", "rep"), labels)
    out = signed.select("doc_id", "text_hash", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n", "s1", "s2", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns: one for each group.

    Rows without words are linked with nothing and all stay. Of rows with the same doc_id and equal sets one
    stays, the least by a hash of the row; where their sets differ, one of each. A row without doc_id stays
    where no document has its set, one for each set.
    """
    null_id = F.col("doc_id").isNull().alias("null_id")
    kept = _grouped(docs).filter("kept and n > 0")
    kept = kept.groupBy(null_id, F.coalesce("doc_id", F.lit(0)).alias("id"), "s1", "s2").agg(F.min("text_hash").alias("text_hash"))
    row = docs.select(whole_row(docs).alias("row"), row_hash(docs).alias("tie"), name("doc_id").isNull().alias("null_id"), F.coalesce(name("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(name("text")).alias("text_hash"))
    same = ["null_id", "id", "text_hash"]
    chosen = row.join(kept.select(*same).distinct(), same).groupBy(*same).agg(F.min_by("row", "tie").alias("row"))
    blank = docs.filter(~F.coalesce(name("text"), F.lit("")).rlike(WORD))
    return chosen.select("row.*").unionByName(blank)
