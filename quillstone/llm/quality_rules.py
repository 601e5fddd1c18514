"""Quality rules: statistics of a text against fixed thresholds, and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed words, word pairs and character trigrams and 5-grams, each
as its share of the text's n-grams of that kind. It is trained on a bounded sample of labelled rows, half
of either label as far as there are enough; a part of the sample is held back to calibrate the
probabilities. Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import name
from quillstone.llm.words import WordHashes, mixed

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
FOLLOWING = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
MOST_REPEATED = 50
THRESHOLD = 0.5
#: Labelled rows to train on, of each label, at most.
SAMPLE = 1200
BITS = 16
KINDS = 4


def text_stats(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    chars = len(text.translate(None, SPACE + FOLLOWING))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes)


def repeated_words(h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more, the first one included."""
    if h.size < 4:
        return 0
    three = mixed(h[:-2] + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(three, kind="stable")
    same = three[order[1:]] == three[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(three.size, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(h.size, bool)
    for i in range(3):
        covered[i : i + again.size] |= again
    return int(covered.sum())


def ngrams(text: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the text's words, word pairs, and trigrams and 5-grams of its code points."""
    down = np.uint64(64 - BITS)
    pairs = mixed(hashes[:-1] + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
    b = np.frombuffer(text if text.isascii() else text.decode().encode("utf-32-le"), np.uint8 if text.isascii() else np.uint32)
    out = [(hashes >> down).astype(np.intp), (pairs >> down).astype(np.intp)]
    for size, factor in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        code = np.zeros(max(0, b.size - size + 1), np.uint32)
        for i in range(size):
            code *= np.uint32(0x01000193)
            code += b[i : i + code.size]
        out.append((code * np.uint32(factor) >> np.uint32(32 - BITS)).astype(np.intp))
    return out


@dataclass
class Model:
    """Weights by kind and bucket, and the line that turns their sum into a log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, grams: list[np.ndarray]) -> float:
        return self.bias + sum(float(w[g].mean()) for w, g in zip(self.weights, grams, strict=True) if g.size)

    def probability(self, grams: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(grams) + self.shift, -30, 30))))


def fit(texts: list[bytes], labels: list[int], rounds: int = 150, step: float = 0.3, penalty: float = 1e-4) -> Model:
    """Train on all texts but every fourth, by Adam over the whole batch; calibrate on the rest.

    Without texts of both labels the model says 0.5 for everything.
    """
    model = Model(np.zeros((KINDS, 1 << BITS), np.float32), 0.0)
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return model
    hashes = WordHashes()
    rows, cols, vals = [], [], []
    everything = [ngrams(t, hashes.of(t.split())) for t in texts]
    held = np.array([zlib.crc32(t) % 4 == 0 for t in texts])
    for i, grams in enumerate(everything):
        for kind, g in enumerate(grams):
            if g.size:
                u, c = np.unique(g, return_counts=True)
                rows.append(np.full(u.size, i))
                cols.append(u + (kind << BITS))
                vals.append(c / g.size)
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    used, col = np.unique(col, return_inverse=True)
    keep = ~held[row]
    row_t, col_t, val_t = row[keep], col[keep], val[keep]
    w, b = np.zeros(used.size), 0.0
    m, s, mb, sb = np.zeros(used.size), np.zeros(used.size), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for k in range(1, rounds + 1):
        z = np.bincount(row_t, val_t * w[col_t], minlength=y.size) + b
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col_t, val_t * d[row_t], minlength=used.size) + penalty * w * 1e-3
        gb = d.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        b -= 0.1 * step * (mb / (1 - 0.9**k)) / (np.sqrt(sb / (1 - 0.999**k)) + 1e-8)
    model.weights.reshape(-1)[used] = w
    model.bias = float(b)
    z = np.bincount(row, val * w[col], minlength=y.size) + b
    model.slope, model.shift = calibration(z[held], y[held])
    return model


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds, by Newton's method on smoothed labels; unchanged for one label only."""
    if y.size < 8 or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, x.T @ (p - t))
        a -= np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-8:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, condition=None) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``most`` rows of either label, chosen by a hash of doc_id.

    ``condition`` holds for the ids (``id``) to choose from. Only the ids chosen, a bounded number, are broadcast
    to find their texts. Where an id has several texts, the least one by their hash is its text; where it has
    several labels, the least one is its label.
    """
    rows = labels.select(name("doc_id").cast("long").alias("id"), name(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    rows = rows if condition is None else rows.filter(condition)
    chosen = [rows.filter(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    slim = docs.select(name("doc_id").cast("long").alias("id"), F.coalesce(name("text"), F.lit("")).alias("text"))
    got = slim.join(ids, "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text")).collect()
    got.sort(key=lambda r: (r.id, r.text))
    return [r.text.encode() for r in got], [r.y for r in got]


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double"


def score_with(model: Model):
    """A function from Arrow batches of (doc_id, text) to batches of statistics and the model's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        fields = [pa.field("doc_id", pa.int64()), *[pa.field(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], pa.field("quality", pa.float64())]
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()):
                t = text.as_py() or b""
                words = t.split()
                h = hashes.of(words)
                rows.append((*text_stats(t, words, h), model.probability(ngrams(t, h))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, fields[1:], strict=True)]], schema=pa.schema(fields))

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the statistics, base_failed, quality, kept.

    A null text counts as empty and, having fewer than 50 words, fails. ``quality`` is the calibrated
    probability of a good label; ``kept`` needs it at ``threshold`` and no failed rule. Where ``labels``
    (doc_id, quality) has not both labels, every text has 0.5. Texts are read whole, however long; repeated
    rows and rows with one doc_id have a row each. Other columns, whatever their names, are not read. An empty
    table gives an empty result.
    """
    model = fit(*labelled_sample(docs, labels, "quality", most))
    slim = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = slim.mapInArrow(score_with(model), OUT).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
