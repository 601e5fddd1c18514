import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import collocations
from sql_rows import same_rows


def by_hand(rows, least, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    some = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *w), a in some.items():
        score, k = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = any(x[0] == lang and len(x) - 1 > len(w) and 100 * b >= 80 * a and any(list(x[s : s + len(w)]) == w for s in range(1, len(x) - len(w) + 1)) for x, b in some.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, of in out.items() for r, (s, a, p, left, right) in enumerate(sorted(of)[:top], 1))


def some_rows(seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "é", "日本", "x-y", " q", "rare%d"]
    rows = [("".join(rng.choice(words).replace("%d", str(rng.randrange(99))) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, ""])) for _ in range(120)]
    return [*rows, (None, "en"), ("", None), (" \t", "en"), *[("The end of a long passage", "en")] * 40]


@pytest.mark.parametrize("most_words", [collocations.DICTIONARY_WORDS, 0])
def test_phrases_by_hand(spark, most_words):
    rows = some_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.mine_phrases(df, least=5, most_words=most_words)
    want = by_hand(rows, 5)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, collocations.mine_phrases(df, least=5, top=7, most_words=most_words).collect())) == by_hand(rows, 5, 7)


def test_flushes_and_ranges_change_nothing(spark, monkeypatch):
    rows = some_rows(8)
    for name, value in (("SORT_KEYS", 50), ("COUNTED_WORDS", 20), ("LEAST_RANGES", 3), ("RANGE_WORDS", 10)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.mine_phrases(spark.createDataFrame(rows, "text string, lang string"), least=4)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 4)


def test_exact_arithmetic_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids)
    cand = spark.createDataFrame([(2, bytearray(key(1, 2)), big)], "n int, key binary, f long")
    counts = spark.createDataFrame([(bytearray(key(1)), big + 7, "en"), (bytearray(key(2)), big + 5, "en")], "key binary, f long, lang string")
    row = collocations.scored(cand, counts).first()
    assert row.score == 2_000_000 * big // (2 * big + 12)
    longer = spark.createDataFrame([(3, bytearray(key(1, 2, 3)), big // 10 * 8)], "n int, key binary, f long")
    of = cand.selectExpr("key", "f as a")
    assert collocations.not_held(of, longer).count() == 0
    assert collocations.not_held(of.selectExpr("key", "a + 1 as a"), longer).count() == 1


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**32 - 1), st.integers(0, 70_000)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_radix_order_and_runs(rows):
    lead = np.array([r[0] for r in rows], np.uint32)
    ids = np.array([r[1:] for r in rows], np.uint32).reshape(-1, 2)
    assert [rows[i] for i in collocations.radix_order([lead, ids[:, 0], ids[:, 1]])] == sorted(rows)
    a, b, n = collocations.runs(lead, ids, np.ones(len(rows), np.int64))
    assert {(x, *y): t for x, y, t in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)} == Counter(rows)


def test_odd_rows(odd, none):
    assert collocations.mine_phrases(none).count() == 0
    got = {(r.lang, r.phrase): r.a for r in collocations.mine_phrases(odd.withColumn("word", F.lit(1)).withColumn("a.b", F.lit(1)), least=2).collect()}
    assert got["en", "w w w w"] == 29_997 and ("en", "w w w") not in got
    assert got["en", "a b c d"] == 4 and got["en", "e f g h"] == 4


def test_same_rows_as_sql(spark):
    same_rows(spark, "op13_phrases")
