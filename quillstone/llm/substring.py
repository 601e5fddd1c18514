"""Substring deduplication: words covered by 20-word windows that start earlier elsewhere are removed.

Every window has a minimiser: the least hash of the 8-word runs in it. Equal windows have equal minimisers,
so windows are dealt to shards by their minimiser, and a shard's index answers for all its windows. Indexes
cut by document instead would need every document streamed through every shard, at a cost of documents
times shards.

1. One pass over the texts gives each document's number of words, its digest, its distinct minimisers (about
   one in seven words), and whether it repeats a window itself. Documents with equal words form a class; all
   but the first of a class repeat it whole.
2. Minimisers of at least two documents are found; only windows with these go on, as pieces: the words that
   neighbouring windows with one minimiser cover.
3. Within a minimiser the documents are ranked. For each bit of the ranks, the pieces of those with the bit
   0 are put in a compressed FM-index (BWT in a wavelet matrix), and those of the documents with the bit 1
   that agree in all higher bits are streamed through it by backward search: every document so meets every
   earlier one once. The matching statistics of 20 words and more are reported as intervals.
4. A minimiser of very many documents (BUSY) would bring each of them to one shard with words of its own
   around what is shared. Its windows are counted by hash first, which combines before the shuffle; the
   shared ones alone make pieces, by a second minimiser of 14 words, and equal pieces are combined to the
   first document's before they come to a shard. They go through the same indexes, and no result depends
   on which way windows went.
5. What is left is computed from the whole text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name, ordered_id, small, small_lists
from quillstone.llm.fm_index import FmIndex
from quillstone.llm.words import WordHashes, mixed

WINDOW = 20
#: Words in the runs that give minimisers, and in those that give second ones.
RUN, RUN2 = 8, 14
#: Documents with a minimiser from which on its windows are counted, and equal pieces combined, before they are sharded.
BUSY = 4096
#: Windows in a piece, at most, and words in one index, about.
PIECE, SHARD_WORDS = 64, 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, second minimiser and hash of every window of a document's word hashes."""
    m = h.size - WINDOW + 1
    if m < 1:
        none = np.empty(0, np.uint64)
        return none, none, none
    r = h[: h.size - RUN + 1].copy()
    for i in range(1, RUN):
        r *= np.uint64(0x9E3779B97F4A7C15)
        r += h[i : h.size - RUN + 1 + i]
    r = mixed(r)
    long = mixed(r[: h.size - RUN2 + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + r[RUN2 - RUN :])
    whole = r[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + r[RUN : RUN + m] * np.uint64(0x165667B19E3779F9) + r[WINDOW - RUN : WINDOW - RUN + m] * np.uint64(0x27D4EB2F165667C5)
    return _least(r, WINDOW - RUN + 1), _least(long, WINDOW - RUN2 + 1), mixed(whole)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    n, step = values.size - width + 1, 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:n], values[width - step : width - step + n])


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if a.size else a


def _with_id(docs: DataFrame) -> DataFrame:
    return docs.select(ordered_id(name("doc_id"), name("text")).alias("doc_id"), name("text").alias("text"), name("doc_id").isNull().alias("no_id"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([p.size for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in range(0, batch.num_rows, 1000):
            some = batch.slice(part, 1000)
            n, sha, own, mins = [], [], [], []
            for value in some.column(1).cast(pa.large_binary()):
                words = (value.as_py() or b"").split()
                low, _, whole = windows(hashes.of(words))
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                own.append(distinct(whole).size < whole.size)
                mins.append(distinct(low))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(own, pa.bool_()), _lists(mins), some.column(2)], names=["doc_id", "n_words", "sha", "own", "mins", "no_id"])


def _held_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, minimisers) to the distinct windows (w, doc_id) that have one of these."""
    hashes = WordHashes()
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            some = batch.slice(part, 500)
            ids, out = [], []
            for doc_id, value, shared in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary()), some.column(2), strict=True):
                low, _, whole = windows(hashes.of((value.as_py() or b"").split()))
                if shared.is_valid and whole.size:
                    w = distinct(whole[np.isin(low, shared.values.to_numpy().view(np.uint64))])
                    ids.append(np.full(w.size, doc_id))
                    out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.empty(0, np.uint64)]).view(np.int64)), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]))], names=["w", "doc_id"])


def pieces_of(low: np.ndarray, keep: np.ndarray) -> list[tuple[int, int]]:
    """(first window, windows) of the runs of windows to keep that have one minimiser."""
    if not keep.any():
        return []
    cut = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (keep[1:] != keep[:-1]))))
    runs = zip(cut.tolist(), np.diff(np.append(cut, low.size)).tolist(), strict=True)
    return [(a + k, min(PIECE, n - k)) for a, n in runs if keep[a] for k in range(0, n, PIECE)]


PIECES = "m long, doc_id long, start int, words array<int>"


def _pieces_by(select):
    """A function from batches (doc_id, text, hashes) to the distinct pieces of each document: PIECES.

    ``select`` gives the minimisers to cut by, and which windows to keep, from ``windows`` and the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 250):
                some = batch.slice(part, 250)
                m, ids, starts, out = [], [], [], []
                for doc_id, value, wanted in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary()), some.column(2), strict=True):
                    h = hashes.of((value.as_py() or b"").split())
                    ids32 = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    by, keep = select(*windows(h), wanted.values.to_numpy().view(np.uint64))
                    seen = set()
                    for a, n in pieces_of(by, keep):
                        words = ids32[a : a + n + WINDOW - 1]
                        key = words.tobytes()
                        if key not in seen:
                            seen.add(key)
                            m.append(int(by[a].view(np.int64)))
                            ids.append(doc_id)
                            starts.append(a)
                            out.append(words)
                offsets = pa.array(np.concatenate(([0], np.cumsum([w.size for w in out]))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*out, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), lists], names=["m", "doc_id", "start", "words"])

    return run


_pieces = _pieces_by(lambda low, low2, whole, wanted: (low, np.isin(low, wanted)))
#: Of windows counted by hash; the two minimisers are one key.
_counted_pieces = _pieces_by(lambda low, low2, whole, wanted: (mixed(low + mixed(low2)), np.isin(whole, wanted)))


def earlier_in_shard(m: np.ndarray, doc: np.ndarray, start: np.ndarray, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, windows) of the windows of a shard's pieces that an earlier document has."""
    size = np.diff(cuts)
    place = np.arange(words.size) - np.repeat(cuts[:-1], size)
    h = np.add.reduceat(mixed(words.view(np.uint32).astype(np.uint64) + mixed(place.astype(np.uint64) + np.uint64(1))), cuts[:-1]) + mixed(m.view(np.uint64))
    order = np.lexsort((start, doc, h))
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    first = order[new]
    own = np.empty(doc.size, np.int64)
    own[order] = np.repeat(doc[first], np.diff(np.append(np.flatnonzero(new), doc.size)))
    copies = doc != own
    out = [(doc[copies], start[copies].astype(np.int64), size[copies] - WINDOW + 1)]
    # The documents of each minimiser by rank; where there is one alone it meets no other.
    pieces = first[np.lexsort((doc[first], m[first]))]
    change = np.concatenate(([True], m[pieces[1:]] != m[pieces[:-1]]))
    group = np.cumsum(change) - 1
    rank = np.cumsum(np.concatenate(([True], (doc[pieces[1:]] != doc[pieces[:-1]]) | change[1:]))) - 1
    rank -= rank[change][group]
    most = np.maximum.reduceat(rank, np.flatnonzero(change))[group]
    wide = int(most.max()) + 1
    for bit in range(wide.bit_length()):
        context, later = (rank >> (bit + 1)) + group * wide, (rank >> bit & 1).astype(bool)
        # Both sides of a context, or there is nothing to search or nowhere to search it.
        both = np.flatnonzero((most >> bit > 0) & np.isin(context, context[later]) & np.isin(context, context[~later]))
        if both.size:
            found, windows_of = _streamed(pieces[both], context[both], later[both], words, cuts)
            piece = pieces[both][found[0]]
            out.append((doc[piece], start[piece] + found[1], found[2]))
            # A piece with all its windows in earlier ones adds nothing to later indexes.
            done = both[windows_of == size[pieces[both]] - WINDOW + 1]
            pieces, group, rank, most = (np.delete(x, done) for x in (pieces, group, rank, most))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _streamed(pieces: np.ndarray, context: np.ndarray, later: np.ndarray, words: np.ndarray, cuts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Stream the later ones of the pieces through an index of the others; words match within a context only.

    Gives (place in ``pieces``, offset, windows) of the intervals found, and the windows found of each piece.
    """
    size = cuts[pieces + 1] - cuts[pieces]
    starts = lambda of: np.concatenate(([0], np.cumsum(size[of])))
    cut = starts(slice(None))
    text = words[np.repeat(cuts[pieces] - cut[:-1], size) + np.arange(cut[-1])].view(np.uint32).astype(np.uint64)
    # Ids of (context, word), from 64 bits for the two.
    _, ids = np.unique(mixed(text + mixed(np.repeat(context, size).astype(np.uint64))), return_inverse=True)
    streamed = np.repeat(later, size)
    cut = starts(later)
    there = np.flatnonzero(FmIndex(ids[~streamed], starts(~later), WINDOW).statistics(ids[streamed], cut) >= WINDOW)
    owner = np.repeat(np.arange(cut.size - 1), np.diff(cut))[there]
    windows_of = np.zeros(pieces.size, np.int64)
    windows_of[later] = np.bincount(owner, minlength=cut.size - 1)
    run = np.flatnonzero(np.concatenate(([True], (np.diff(there) != 1) | (np.diff(owner) != 0)))) if there.size else there
    return (np.flatnonzero(later)[owner[run]], there[run] - cut[owner[run]], np.diff(np.append(run, there.size))), windows_of


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by minimiser to intervals of windows: a partition is cut into shards between minimisers."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0

    def results(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, total
        m, doc, start, words, size = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = m.size if end else int(np.flatnonzero(m == m[-1])[0])
        cuts = np.concatenate(([0], np.cumsum(size)))
        if cut:
            found = earlier_in_shard(m[:cut], doc[:cut], start[:cut], words[: cuts[cut]], cuts[: cut + 1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "start", "windows"])
        held = [(m[cut:], doc[cut:], start[cut:], words[cuts[cut] :], size[cut:])]
        total = int(cuts[-1] - cuts[cut])

    for batch in batches:
        if batch.num_rows:
            lists = batch.column(3)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), lists.flatten().to_numpy(), size))
            total += int(size.sum())
            if total >= SHARD_WORDS:
                yield from results(False)
    if held and total:
        yield from results(True)


def repeated(whole: np.ndarray) -> np.ndarray:
    """Which windows start before in the same document."""
    out = np.zeros(whole.size, bool)
    order = np.argsort(whole, kind="stable")
    out[order[1:][whole[order[1:]] == whole[order[:-1]]]] = True
    return out


def intervals_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Covered words as intervals (end exclusive), from sorted starts of windows."""
    if not starts.size:
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [starts.size - 1]))
    return list(zip(starts[first].tolist(), (starts[last] + WINDOW).tolist(), strict=True))


def cut_out(words: list[bytes], intervals: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for a, b in intervals:
        kept += words[at:a]
        at = b
    return kept + words[at:]


INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of windows that start earlier elsewhere) to (doc_id, sha, intervals, kept_sha256)."""
    hashes = WordHashes()
    for batch in batches:
        sha, spans, kept = [], [], []
        for value, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            words = (value.as_py() or b"").split()
            gone = repeated(windows(hashes.of(words))[2])
            for f in found.as_py():
                gone[f["start"] : f["start"] + f["windows"]] = True
            cut = intervals_of(np.flatnonzero(gone))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(hashlib.sha256(b" ".join(cut_out(words, cut))).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(spans, INTERVALS), pa.array(kept, pa.string())], names=["doc_id", "sha", "intervals", "kept_sha256"])


def _busy_pieces(slim: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of busy (m, doc_id) minimisers: the distinct pieces with the first document of each, and the spans
    (doc_id, start, windows) of the other documents that hold them.

    Where few documents have busy minimisers, texts are found by a broadcast of these and not shuffled.
    """
    of = checkpointed(busy.groupBy("doc_id").agg(F.collect_list("m").alias("wanted")))
    held = checkpointed(slim.join(small_lists(of, "wanted"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_held_windows, "w long, doc_id long"))
    shared = held.groupBy("w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("w")
    wanted = checkpointed(held.join(checkpointed(shared), "w").groupBy("doc_id").agg(F.collect_list("w").alias("wanted")))
    pieces = checkpointed(slim.join(small_lists(wanted, "wanted"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_counted_pieces, PIECES))
    pieces = pieces.withColumn("piece", F.struct("m", F.xxhash64("words"), F.hash("words")))
    first = checkpointed(pieces.groupBy("piece").agg(F.min(F.struct("doc_id", "start", "m", "words")).alias("first")))
    copies = pieces.join(first.select("piece", F.col("first.doc_id").alias("of")), "piece").filter("doc_id <> of")
    return first.select("first.m", "first.doc_id", "first.start", "first.words"), copies.select("doc_id", F.col("start").cast("long").alias("start"), (F.size("words") - WINDOW + 1).cast("long").alias("windows"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, intervals, n_removed, kept_sha256.

    ``intervals`` are the removed words (start, end exclusive), ``kept_sha256`` the digest of those left,
    joined by one space. Texts of under 20 words, null ones too, keep all. Rows with the same doc_id are one
    document with more than one text: neither makes the other's windows earlier. Rows without doc_id come
    after all others (but for doc_ids of 2^62 and more, among which they are ordered), in the order of a hash of
    their text, and those with equal texts are one document.
    Other columns, whatever their names, are not read. An empty table gives an empty result. Words are
    compared as 32-bit hashes, windows as 20 of these: two windows that differ in one word are taken for equal
    once in four thousand million.
    """
    slim = _with_id(docs)
    read = checkpointed(slim.mapInArrow(_digests, "doc_id long, n_words long, sha string, own boolean, mins array<long>, no_id boolean"))
    classes = read.filter(f"n_words >= {WINDOW}").groupBy("sha").agg(F.min("doc_id").alias("first"))
    read = read.join(classes, "sha", "left")
    firsts = read.filter("doc_id = first")

    holders = firsts.select(F.explode("mins").alias("m"), "doc_id")
    shared = holders.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1")
    shared = checkpointed(shared.select("m", (F.col("n") >= BUSY).alias("busy")))
    # Busy minimisers are few. While they are, they are broadcast, and no task gathers the holders of one.
    busy = small(shared.filter("busy"))
    marked = holders.join(busy, "m", "left")
    calm = marked.filter("busy is null").join(shared.filter("not busy").select("m"), "m").groupBy("doc_id").agg(F.collect_list("m").alias("wanted"))
    pieces = slim.join(calm, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_pieces, PIECES)
    copies = None
    if not busy.isEmpty():
        combined, copies = _busy_pieces(slim, marked.filter("busy").select("m", "doc_id"))
        pieces = pieces.unionByName(combined)
    spans = pieces.repartition("m").sortWithinPartitions("m").mapInArrow(_search_shards, "doc_id long, start long, windows long")
    spans = spans if copies is None else spans.unionByName(copies)

    own = firsts.filter("own").select("doc_id")
    changed = spans.select("doc_id", F.struct("start", "windows").alias("span")).unionByName(own, allowMissingColumns=True)
    changed = changed.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    changed = slim.join(changed, "doc_id").select("doc_id", "text", "spans").mapInArrow(_changes, "doc_id long, sha string, intervals array<struct<start: long, end: long>>, kept_sha256 string").dropDuplicates(["doc_id", "sha"])
    out = read.select("doc_id", "no_id", "n_words", "sha", "first").join(changed, ["doc_id", "sha"], "left")
    copy = F.col("first") < F.col("doc_id")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    intervals = F.when(copy, everything).otherwise(F.coalesce("intervals", F.array().cast("array<struct<start: long, end: long>>")))
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, i: n + i["end"] - i["start"])
    kept = F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha"))
    shown = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    out = out.select(shown, "n_words", intervals.alias("intervals"), kept.alias("kept_sha256"))
    return out.withColumn("n_removed", removed)
