"""Benchmark decontamination: a BM25 index of the test items, searched by every passage of every document.

Items are the indexed side. An item's score for a passage is the BM25 sum over the passage's distinct
terms, as a share of the item's score for its own text, so one threshold fits all items. Retrieval is
exhaustive above the threshold and skips by upper bounds, as block-max WAND does:

* Terms are split so that the commoner ones alone can give no item the threshold; a passage whose rarer
  terms' greatest weights do not make up the difference is skipped before any list is read.
* Lists are cut into blocks of neighbouring items with the greatest weight of each; only blocks whose
  maxima sum up to the threshold have their items scored.

A retrieved item counts when enough word n-grams of both its question and its answer stand in the passage.
Passages are windows of twice the longest item, each starting one item length after the last, so every
occurrence lies within one. Items are indexed in shards of bounded size and like length, many of which go with
one pass over the documents; document frequencies, item count and mean length are those of the whole benchmark and the longest item that of the length
class, so how a class is cut into shards changes no score and no passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, filtered, name

K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Share of an item's own score that the commoner terms may make up.
COMMON = 0.35
OVERLAP = 0.6
GRAM = 5
#: The last third of an item's words is its answer where none is marked.
ANSWER = 1 / 3
BLOCK = 4
#: Items of a shard, and terms of all of them, at most, about; one item is never cut.
SHARD_ITEMS, SHARD_TERMS = 4096, 400_000
#: Postings of the shards that one pass over the documents takes, at most, about: 20 bytes each in every task.
PASS_POSTINGS = 4_000_000
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(PUNCTUATION).split()


def parts_of(words: list[bytes]) -> list[set[tuple[bytes, ...]]]:
    """The word n-grams of the question and of the answer; a shorter part is one n-gram; one word is both."""
    cut = max(1, len(words) - max(1, round(len(words) * ANSWER)))
    parts = [words[:cut], words[cut:] or words]
    return [{tuple(p[i : i + GRAM]) for i in range(max(1, len(p) - GRAM + 1))} for p in parts]


@dataclass
class Whole:
    """What a shard has to know of all items: their count, mean length and document frequencies, and the longest of its class."""

    items: int
    mean: float
    df: dict[bytes, int]
    longest: int


class Index:
    """One shard's lists, block maxima and bounds. Without ``whole`` its items are all there are."""

    def __init__(self, items: list[tuple[int, list[bytes]]], whole: Whole | None = None):
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(w) for _, w in items]
        self.grams = [[min(GRAM, len(next(iter(p)))) for p in q] for q in self.parts]
        self.longest = whole.longest if whole else max(len(w) for _, w in items)
        self.vocabulary: dict[bytes, int] = {}
        lengths = np.array([len(w) for _, w in items], float)
        t, d, f = [], [], []
        for i, (_, words) in enumerate(items):
            u, c = np.unique([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], return_counts=True)
            t.append(u)
            d.append(np.full(u.size, i))
            f.append(c)
        term, item, tf = np.concatenate(t), np.concatenate(d), np.concatenate(f).astype(float)
        n = len(self.vocabulary)
        df = np.bincount(term, minlength=n)
        count, mean = (whole.items, whole.mean) if whole else (len(items), lengths.mean())
        of_all = np.array([whole.df[t] for t in self.vocabulary], float) if whole else df
        idf = np.log(1 + (count - of_all + 0.5) / (of_all + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        weight /= np.bincount(item, weight)[item]
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(df)))
        most = np.zeros(n)
        np.maximum.at(most, term, weight)
        key, at = np.unique(term[order] * (item.max() // BLOCK + 1) + self.item // BLOCK, return_inverse=True)
        self.block = key % (item.max() // BLOCK + 1)
        self.block_most = np.zeros(key.size)
        np.maximum.at(self.block_most, at, self.weight)
        self.block_start = np.searchsorted(key // (item.max() // BLOCK + 1), np.arange(n + 1))
        # Commoner terms first, as long as no item gets more than COMMON from them.
        gained, rare = np.zeros(len(items)), np.ones(n, bool)
        for term_id in np.argsort(-df, kind="stable"):
            i, j = self.start[term_id], self.start[term_id + 1]
            if (gained[self.item[i:j]] + self.weight[i:j]).max() > COMMON:
                break
            gained[self.item[i:j]] += self.weight[i:j]
            rare[term_id] = False
        # What the rarer terms have to make up in each block.
        self.rare = rare
        self.rest = THRESHOLD - np.maximum.reduceat(gained, np.arange(0, len(items), BLOCK))

    def search(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that score the threshold or more for these distinct terms, and their scores."""
        lists = [slice(self.block_start[t], self.block_start[t + 1]) for t in terms]
        bound = np.bincount(np.concatenate([self.block[s] for s in lists]), np.concatenate([self.block_most[s] for s in lists]))
        if not (bound >= THRESHOLD - 1e-9).any():
            return np.empty(0, int), np.empty(0)
        lists = [slice(self.start[t], self.start[t + 1]) for t in terms]
        item, weight = np.concatenate([self.item[s] for s in lists]), np.concatenate([self.weight[s] for s in lists])
        open_ = bound[item // BLOCK] >= THRESHOLD - 1e-9
        score = np.bincount(item[open_], weight[open_])
        found = np.flatnonzero(score >= THRESHOLD - 1e-9)
        return found, score[found]

    def _passing(self, terms: np.ndarray, stretch: np.ndarray, passages: int) -> np.ndarray:
        """Passages whose rarer terms may lift some block to the threshold.

        ``stretch`` tells in which item length of the document each term stands; passage k is stretches k and k + 1.
        """
        kept = self.rare[terms]
        terms, stretch = terms[kept], stretch[kept]
        out = []
        for first in range(0, passages, 256):
            some = min(256, passages - first)
            i, j = np.searchsorted(stretch, [first, first + some + 1])
            n = self.block_start[terms[i:j] + 1] - self.block_start[terms[i:j]]
            at = np.repeat(self.block_start[terms[i:j]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            cell = np.repeat(stretch[i:j] - first, n) * self.rest.size + self.block[at]
            sums = np.bincount(cell, self.block_most[at], minlength=(some + 1) * self.rest.size).reshape(some + 1, -1)
            out.append(np.flatnonzero(((sums[:-1] + sums[1:]) >= self.rest - 1e-6).any(axis=1)) + first)
        return np.concatenate(out)

    def matches(self, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
        """Items found in a document: index to the best passage's (score, question overlap, answer overlap)."""
        out: dict[int, tuple[float, float, float]] = {}
        terms = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        if not at.size:
            return out
        starts = np.arange(0, max(1, len(words) - self.longest), self.longest)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + 2 * self.longest)
        for k in self._passing(terms[at], at // self.longest, starts.size):
            found, scores = self.search(np.unique(terms[at[lo[k] : hi[k]]]))
            if not found.size:
                continue
            passage = words[starts[k] : starts[k] + 2 * self.longest]
            grams: dict[int, set] = {}
            for i, score in zip(found.tolist(), scores.tolist(), strict=True):
                shares = []
                for part, size in zip(self.parts[i], self.grams[i], strict=True):
                    if size not in grams:
                        grams[size] = {tuple(passage[j : j + size]) for j in range(max(1, len(passage) - size + 1))}
                    shares.append(len(part & grams[size]) / len(part))
                if min(shares) >= OVERLAP:
                    out[i] = max(out.get(i, (0.0, 0.0, 0.0)), (score, *shares))
        return out


def shards(benchmark: DataFrame) -> Iterator[Index]:
    """The indexes of a benchmark (item_id, text): one for each length class and SHARD_ITEMS items or so.

    Equal items are one. Items without words are left out; a null text has none. Of the whole benchmark the driver
    has only the counts by class; items and the frequencies of their terms come shard by shard.
    """
    n = F.length(F.bin(F.size(F.split(F.coalesce(name("text"), F.lit("")), r"\s+"))))
    distinct = benchmark.select(name("item_id").cast("long").alias("item_id"), name("text").alias("text"), n.alias("length_class")).distinct()
    rows = checkpointed(distinct.mapInArrow(_with_terms, "item_id long, text string, length_class long, n_terms long, terms array<string>"))
    classes = sorted(map(tuple, rows.groupBy("length_class").agg(F.count("*"), F.sum("n_terms"), F.max("n_terms")).collect()))
    count, total = sum(c for _, c, _, _ in classes), sum(t for *_, t, _ in classes)
    frequencies = checkpointed(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    for length_class, of_class, terms, longest in classes:
        cuts = max(-(-of_class // SHARD_ITEMS), -(-terms // SHARD_TERMS))
        for k in range(cuts):
            part = rows.filter(F.col("length_class") == length_class)
            part = part if cuts == 1 else part.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)) == k)
            items = sorted((r.item_id is None, r.item_id or 0, r.text) for r in part.select("item_id", "text").collect())
            if not items:
                continue
            own = part.select(F.explode("terms").alias("term")).distinct().join(frequencies, "term")
            df = {r.term.encode(): r.df for r in own.collect()}
            yield Index([(None if null else i, terms_of(t)) for null, i, t in items], Whole(count, total / count, df, longest))


def passes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The shards' indexes, as many at a time as a task may hold."""
    some: list[Index] = []
    for index in shards(benchmark):
        if some and sum(x.item.size for x in some) + index.item.size > PASS_POSTINGS:
            yield some
            some = []
        some.append(index)
    if some:
        yield some


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words, with the count of their words and the distinct ones."""
    for batch in batches:
        words = [terms_of(t.as_py()) for t in batch.column(1)]
        kept = batch.filter(pa.array([bool(w) for w in words], pa.bool_()))
        words = [w for w in words if w]
        columns = [kept.column(0), kept.column(1), kept.column(2).cast(pa.int64()), pa.array(map(len, words), pa.int64()), pa.array([[t.decode() for t in dict.fromkeys(w)] for w in words], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "length_class", "n_terms", "terms"])


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score and the two overlaps.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null and blank texts of either hold
    nothing and are found in nothing. Repeated documents are each searched, repeated items once; without items
    the result is empty. Texts are searched whole, however long. Other columns, whatever their names, are not
    read.
    """
    slim = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"))

    def search_with(indexes: list[Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = terms_of(text.as_py())
                    rows += [(doc_id, index.ids[i], *found) for index in indexes for i, found in sorted(index.matches(words).items())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

        return run

    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], ddl)
    for indexes in passes(benchmark):
        out = out.unionByName(slim.mapInArrow(search_with(indexes), ddl))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with their own columns, whatever their names."""

    def keep_without(indexes: list[Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = (terms_of(t.as_py()) for t in batch.column("text"))
                yield batch.select(["row"]).filter(pa.array([not any(index.matches(w) for index in indexes) for w in words], pa.bool_()))

        return run

    for indexes in passes(benchmark):
        docs = filtered(docs, keep_without(indexes))
    return docs
