import hashlib
import random

import numpy as np

from quillstone.llm import substring
from quillstone.llm.substring import find_repeats


def brute(rows):
    first, out = {}, {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        w = words[d]
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (d, s))
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (d, s):
                gone.update(range(s, s + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in find_repeats(df).collect()}


def test_real_documents(docs):
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_in_random_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 30, 60)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randrange(4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
            w += rng.choice(passages)
            if rng.random() < 0.2:
                w += ["again"] * rng.randrange(50)
        rows.append((d, " \n".join(w)))
    rows += [(d + 1000, t) for d, t in rng.sample(rows, 20)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_small_shards_and_busy_minimisers(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (22, 40, 90, 40)]
    rows = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        for p in rng.sample(passages, rng.randrange(3)):
            p = list(p)
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            w += p + [rng.choice(vocabulary) for _ in range(rng.randrange(10))]
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, words, piece in ((10, 400, 64), (1, 400, 64), (4096, 100, 3), (30, 10**6, 1)):
        monkeypatch.setattr(substring, "BUSY", hot)
        monkeypatch.setattr(substring, "SHARD_WORDS", words)
        monkeypatch.setattr(substring, "PIECE", piece)
        assert found(df) == brute(rows), (hot, words, piece)


def test_rows_without_doc_id(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = text(40), text(40)
    rows = [(None, f"{a} {b}"), (None, f"{a} x"), (None, f"{a} x"), (2**62 - 1, b), (None, text(30))]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == (0, 30, 0) and got[-1] == (2**62 - 1, 40, 0)
    # Which of the two texts is first hangs on their hashes; the copies of one text are one document.
    assert got[1:4] in ([(0, 41, 0), (0, 41, 0), (0, 80, 80)], [(0, 41, 40), (0, 41, 40), (0, 80, 40)])


def test_nothing_is_found_without_the_index(spark, monkeypatch):
    rows = [(d, " ".join(f"w{d}-{i}" for i in range(30)) + " " + " ".join(f"s{i}" for i in range(40)) + f" e{d}") for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    rng = np.random.default_rng(1)
    words = rng.integers(-(2**31), 2**31 - 1, 30, dtype=np.int32)
    shared = (np.array([5, 5]), np.array([1, 2]), np.array([0, 7], np.int32), np.concatenate((words[:25], words[3:28])), np.array([0, 25, 50]))
    assert [x.tolist() for x in substring.earlier_in_shard(*shared)] == [[2], [7], [3]]
    monkeypatch.setattr(substring.FmIndex, "statistics", lambda self, words, starts: np.zeros(words.size, np.int64))
    assert substring.earlier_in_shard(*shared)[0].size == 0


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in find_repeats(odd).collect()}
    assert {(2, 0, 0), (3, 0, 0), (4, 0, 0), (7, 30_000, 29_999), (8, 1, 0)} <= got
    assert find_repeats(odd).count() == 10
    assert find_repeats(none).count() == 0


def test_large_ids_are_kept(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2**62 + 5, text), (2**63 - 1, text), (None, text), (7, "x " + text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[0] for g in got] == [0, 7, 2**62 + 5, 2**63 - 1]
    assert dict(got) == {0: 30, 7: 0, 2**62 + 5: 30, 2**63 - 1: 30}
