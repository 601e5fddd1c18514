"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which takes time
linear in the features. A text's distinct hashed words share one unit of length; the statistics enter as
standardised numbers. Labels, language, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import filtered, name
from quillstone.llm.quality_rules import FOLLOWING, SPACE, SYMBOLS, calibration, labelled_sample, repeated_words
from quillstone.llm.words import WordHashes

BITS = 15
FACTORS = 6
THRESHOLD = 0.7
#: Labelled rows to train on, of each label, at most.
SAMPLE = 2000
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
#: Words that end in a symbol or an exclamation mark.
MARKED = re.compile(rb"[#*$%&|<>!](?=[ \t\n\x0b\x0c\r]|$)")


STATS = 16


def structure(text: bytes, words: list[bytes], h: np.ndarray, distinct: int) -> list[float]:
    """Numbers about the shape of a text; all are 0 for an empty one."""
    n = len(words)
    if not n:
        return [0.0] * STATS
    size = len(text)
    kept = text.translate(None, SPACE + FOLLOWING)
    chars = len(kept)
    share = lambda of: (chars - len(kept.translate(None, of))) / chars
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    marked = len(MARKED.findall(text))
    runs = int((h[1:] == h[:-1]).sum()) if n > 1 else 0
    return [
        np.log1p(n), np.log1p(chars / n), np.log1p(n / len(lines)), share(SYMBOLS), share(b"|"), share(UPPER), share(DIGITS), share(b"!"), share(b".,;:?"),
        marked / n, min(1.0, text.count(b" | ") / n), 1 - len(set(lines)) / len(lines), repeated_words(h) / n, runs / n, distinct / n, (size - len(text.translate(None, FOLLOWING))) / size,
    ]


def features(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, list[float]]:
    """Buckets of the distinct words, and the structure statistics."""
    words = text.split()
    h = hashes.of(words)
    buckets = np.unique((h >> np.uint64(64 - BITS)).astype(np.intp))
    return buckets, structure(text, words, h, np.unique(h).size)


@dataclass
class Machine:
    """w0, weights (bucket or statistic, 1 + FACTORS: w and v), the statistics' mean and scale, the calibration."""

    bias: float
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, buckets: np.ndarray, stats: list[float]) -> float:
        x = np.clip((np.array(stats) - self.mean) / self.scale, -4, 4)
        s = self.weights[1 << BITS :]
        linear = x @ s
        squares = (x * x) @ (s * s)
        if buckets.size:
            u = self.weights[buckets]
            r = 1 / np.sqrt(buckets.size)
            linear = linear + u.sum(axis=0) * r
            squares = squares + np.einsum("ij,ij->j", u, u) * r * r
        return float(self.bias + linear[0] + 0.5 * (linear[1:] ** 2 - squares[1:]).sum())

    def score(self, buckets: np.ndarray, stats: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(buckets, stats) + self.shift, -30, 30))))


def fit(texts: list[bytes], labels: list[int], rounds: int = 150, step: float = 0.03, penalty: float = 0.02, seed: int = 7) -> Machine:
    """Train by Adam over the whole batch on all texts but every fifth, which calibrate the result.

    Both labels weigh the same. Without texts of both labels the machine says 0.5 for everything.
    """
    k = 1 + FACTORS
    rng = np.random.default_rng(seed)
    n_stats = STATS
    size = (1 << BITS) + n_stats
    if len(set(labels)) < 2:
        return Machine(0.0, np.zeros((size, k)), np.zeros(n_stats), np.ones(n_stats), 0.0, 0.0)
    y = np.array(labels, float)
    hashes = WordHashes()
    got = [features(t, hashes) for t in texts]
    held = np.array([zlib.crc32(t) % 5 == 0 for t in texts])
    stats = np.array([s for _, s in got])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    x = np.clip((stats - mean) / scale, -4, 4)
    row = np.repeat(np.arange(y.size), [b.size for b, _ in got])
    used, col = np.unique(np.concatenate([b for b, _ in got]), return_inverse=True)
    val = np.repeat([1 / np.sqrt(max(1, b.size)) for b, _ in got], [b.size for b, _ in got])
    p = np.concatenate([rng.normal(0, 0.05, (used.size, k)), rng.normal(0, 0.05, (n_stats, k))])
    p[:, 0] = 0
    bias = 0.0
    train = ~held
    share = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    m, s, mb, sb = np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
    starts = np.concatenate(([0], np.cumsum([b.size for b, _ in got])))[:-1]
    some = np.array([b.size > 0 for b, _ in got])

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros((y.size, values.shape[1]))
        out[some] = np.add.reduceat(values, starts[some], axis=0)
        return out

    by_col = np.argsort(col, kind="stable")
    col_starts = np.concatenate(([0], np.cumsum(np.bincount(col))))[:-1] if col.size else col
    row_c, val_c = row[by_col], val[by_col][:, None]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        u = p[:-n_stats][col] * val[:, None]
        lin = sums(u) + x @ p[-n_stats:]
        sq = sums(u * u) + (x * x) @ (p[-n_stats:] ** 2)
        return lin, bias + lin[:, 0] + 0.5 * (lin[:, 1:] ** 2 - sq[:, 1:]).sum(axis=1)

    for t in range(1, rounds + 1):
        lin, z = forward()
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        to = lin.copy()
        to[:, 0] = 1
        to *= d[:, None]
        g = np.empty_like(p)
        if used.size:
            g[:-n_stats] = np.add.reduceat(val_c * to[row_c], col_starts, axis=0)
        own = np.bincount(col, val * val * d[row], minlength=used.size)
        g[:-n_stats, 1:] -= p[:-n_stats, 1:] * own[:, None]
        g[-n_stats:] = x.T @ to
        g[-n_stats:, 1:] -= p[-n_stats:, 1:] * ((x * x).T @ d)[:, None]
        g += penalty * p / y.size
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        gb = d.sum()
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        p -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    _, z = forward()
    slope, shift = calibration(z[held], y[held])
    weights = np.zeros((size, k))
    weights[used] = p[:-n_stats]
    weights[1 << BITS :] = p[-n_stats:]
    return Machine(float(bias), weights, mean, scale, slope, shift)


def held_out(doc_id: Column) -> Column:
    """Whether a document is set apart from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_with(machine: Machine):
    """A function from Arrow batches of (doc_id, text) to batches of (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            scores = [machine.score(*features(t.as_py() or b"", hashes)) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(scores, pa.float64())], names=[*batch.schema.names[:1], *batch.schema.names[2:], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    """A machine from at most ``most`` rows of either label in ``labels`` (doc_id, quality), none held out."""
    return fit(*labelled_sample(docs, labels, "quality", most, ~held_out(F.col("id"))))


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    A null text counts as empty and is scored like any other. Without labels of both kinds every score is
    0.5. A null doc_id counts as the empty text when the held-out rows are told apart. Texts are read whole,
    however long; repeated rows and rows with one doc_id have a row each. Other columns, whatever their names,
    are not read. An empty table gives an empty result.
    """
    slim = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"))
    out = slim.mapInArrow(score_with(train(docs, labels, most)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD, source: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their own columns.

    The machine learns from the texts of ``source``, or of ``docs`` itself where none is given. Columns may have any
    names.
    """
    machine = train(docs if source is None else source, labels, most)
    score = score_with(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
            good = next(score(iter([pair]))).column(1).to_numpy() >= threshold
            yield batch.select(["row"]).filter(pa.array(good))

    return filtered(docs, run)
