import functools
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import quality_fm, quality_rules
from quillstone.llm.queries import QUERIES
from quillstone.llm.words import mixed

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p, n = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / p / n


def brute(text):
    t = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    three = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if three[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_statistics(spark, docs):
    rows = quality_rules.quality_rules(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows.collect()} == want


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_quality_fm"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_rules_keep_good_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = QUERIES["op5_quality_rules"](spark, SF).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.label == 1]
    bad = [r.kept for r in rows if r.label == 0]
    assert np.mean(good) > 0.97 and np.mean(bad or [0]) < 0.2


def test_the_identity_gives_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = quality_fm.fit([b"one two three four. " * 5, b"### $$$ %%% &&&" * 9] * 12, [1, 0] * 12, rounds=5)
    m.weights[:] = rng.normal(size=m.weights.shape)
    buckets, stats = np.array([3, 9, 70, 1000]), list(rng.normal(size=quality_fm.STATS))
    x = np.concatenate((np.full(4, 0.5), np.clip((np.array(stats) - m.mean) / m.scale, -4, 4)))
    v = np.concatenate((m.weights[buckets], m.weights[1 << quality_fm.BITS :]))
    pairs = sum(v[i, 1:] @ v[j, 1:] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert np.isclose(m.raw(buckets, stats), m.bias + v[:, 0] @ x + pairs)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for empty in (labels, labels.filter("false")):
        rows = quality_fm.classify(odd, empty).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
        assert {r.kept for r in quality_rules.quality_rules(odd, empty).collect() if r.n_words < 50} == {False}
    assert quality_fm.classify(none, labels).count() == 0 and quality_rules.quality_rules(none, labels).count() == 0
    assert quality_fm.keep_good(odd, labels).columns == odd.columns


def test_clashing_columns_and_repeated_ids(spark, docs):
    clash = docs.select("doc_id", "text", *[docs["doc_id"].alias(c) for c in ("id", "y", "key", "n", "label", "quality", "score")])
    clash = clash.union(clash)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "quality", "doc_id as id", "toxic as y")
    texts, ys = quality_rules.labelled_sample(clash, labels, "quality", 30)
    assert len(texts) == len(ys) <= 60 and quality_rules.labelled_sample(docs, labels, "quality", 30) == (texts, ys)
    assert quality_rules.quality_rules(clash, labels, 30).count() == quality_fm.classify(clash, labels, 30).count() == 2 * docs.count()
    assert quality_fm.keep_good(clash, labels, 30).columns == clash.columns


def test_verdicts_against_plain_code(spark, docs):
    """Both classifiers' rows from their models, each feature counted and each pair multiplied in plain Python."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_rules.fit(*quality_rules.labelled_sample(docs, labels, "quality", 60))
    machine = quality_fm.fit(*quality_rules.labelled_sample(docs, labels, "quality", 60, ~quality_fm.held_out(F.col("id"))))
    scores = {r.doc_id: r for r in quality_fm.classify(docs, labels, 60).collect()}
    verdicts = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels, 60).collect()}
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for d in docs.limit(60).collect():
        t = d.text or ""
        words = t.encode().split()
        h = [xxhash.xxh3_64_intdigest(w) for w in words]
        # The n-gram model: means of weights over words, pairs, and code points in threes and fives.
        mix = lambda x: int(mixed(np.array([x & (1 << 64) - 1], np.uint64))[0])
        code = lambda cs, factor: (functools.reduce(lambda a, c: (a * 0x01000193 + ord(c)) & 0xFFFFFFFF, cs, 0) * factor & 0xFFFFFFFF) >> 16
        grams = [[x >> 48 for x in h], [mix(a + b * 0x9E3779B97F4A7C15) >> 48 for a, b in zip(h, h[1:])]]
        grams += [[code(t[i : i + n], f) for i in range(len(t) - n + 1)] for n, f in ((3, 0x9E3779B1), (5, 0x85EBCA77))]
        raw = model.bias + sum(np.mean([model.weights[k][g] for g in gs]) for k, gs in enumerate(grams) if gs)
        quality = sigmoid(model.slope * raw + model.shift)
        v = verdicts[d.doc_id]
        assert abs(v.quality - quality) < 1e-5
        n_words, *_, again = brute(t)
        failed = n_words < 50 or 100 * again > 50 * n_words
        assert v.base_failed is failed and (v.kept is (not failed and bool(v.quality >= 0.5)))
        # The factorisation machine: the sum over all pairs of features.
        buckets = sorted({x >> (64 - quality_fm.BITS) for x in h})
        stats = np.clip((np.array(quality_fm.structure(t.encode(), words, np.array(h, np.uint64), len(set(h)))) - machine.mean) / machine.scale, -4, 4)
        x = [1 / len(buckets) ** 0.5] * len(buckets) + stats.tolist()
        w = [machine.weights[b] for b in buckets] + list(machine.weights[1 << quality_fm.BITS :])
        if len(x) < 120:
            z = machine.bias + sum(a * u[0] for a, u in zip(x, w)) + sum(x[i] * x[j] * float(w[i][1:] @ w[j][1:]) for i in range(len(x)) for j in range(i))
            assert abs(scores[d.doc_id].score - sigmoid(machine.slope * z + machine.shift)) < 1e-9
        assert scores[d.doc_id].predicted == int(scores[d.doc_id].score >= 0.7)


def test_dotted_columns_pass_the_filtering_stages(spark, odd):
    from pyspark.sql import functions as F

    from quillstone.llm import decontaminate, quality_fm

    dotted = odd.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_fm.keep_good(dotted, labels, threshold=0.0).columns == dotted.columns
    assert quality_fm.keep_good(dotted, labels, threshold=0.0).count() == odd.count()
    items = spark.createDataFrame([(1, "een twee drie vier vijf zes zeven acht negen")], "item_id long, text string")
    kept = decontaminate.drop_leaks(dotted, items)
    assert kept.columns == dotted.columns and kept.count() == odd.count()
