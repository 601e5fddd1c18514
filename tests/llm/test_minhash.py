import random

import numpy as np

from quillstone.llm.minhash import drop_near_duplicates, near_duplicates


def brute(rows):
    """Components over all pairs; rows: (doc_id, text)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    label = {d: d for d in ids}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_groups_of_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for length in (3, 6, 9, 20, 60, 200):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(length)]
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.randrange(0, max(1, length // 12) + 1)):
                    copy[rng.randrange(length)] = rng.choice(words)
                rows.append((n, " ".join(copy)))
                n += 1
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_real_documents(docs):
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect()}
    assert {(1, 4, 1, True), (5, 4, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 4, 1, False)} <= rows
    assert near_duplicates(odd).count() == 10
    assert near_duplicates(none).count() == 0
    assert sorted(r.doc_id or 0 for r in drop_near_duplicates(odd).collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_blocks_of_a_large_group(spark, monkeypatch):
    from quillstone.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 10)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    monkeypatch.setattr(minhash, "ODD", 0)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 10)
    assert found(df) == brute(rows)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [
        (1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "A b c d e f", 2), (1, "quite another text of seven words", 3),
        (None, "a b c d e f", 4), (None, "words that no document with an id has", 5), (None, "words that no document with an id has", 6), (None, "", 7), (None, None, 8), (2, " ", 9),
    ]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, s1 long")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if (r.text or "").strip() and r.doc_id is None) == [(0, rows[5][1])]
    assert sorted(r.text.lower() for r in kept if r.doc_id == 1) == ["a b c d e f", "quite another text of seven words"]
    assert sorted(r.s1 for r in kept if not (r.text or "").strip()) == [7, 8, 9]


def test_members_that_the_first_star_refuses(spark, monkeypatch):
    """One bucket of many unlike texts with a copy each: later stars join what the first refuses, and only they do."""
    from quillstone.llm import minhash

    words = lambda d: [f"w{d % 30}-{i}" for i in range(40)]
    rows = [(d, " ".join(words(d) if d < 30 else words(d)[:-1] + ["x"])) for d in range(60)]
    slim = spark.createDataFrame(rows, "doc_id long, text string")
    bucket = slim.selectExpr("1L as key", "doc_id as rep", "36L as n")
    want = {d: d % 30 for d in range(60)}
    assert {r.node: r.label for r in minhash.links_of(bucket, slim).collect()} == want
    # The same by blocks, where there are too many odd members for stars.
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 7)
    monkeypatch.setattr(minhash, "ODD", 10)
    assert {r.node: r.label for r in minhash.links_of(bucket, slim).collect()} == want
    monkeypatch.setattr(minhash, "_groups", lambda members, slim: members.selectExpr("rep as a", "rep as b").filter("false"))
    assert {r.node: r.label for r in minhash.links_of(bucket, slim).collect()} == {0: 0, 30: 0}


def test_candidates_at_the_limit():
    """Recall of the bands for pairs of documents at 75 to 80 %; README has the figure."""
    from quillstone.llm.minhash import Sketcher

    rng = np.random.default_rng(5)
    sketcher, met = Sketcher(), 0
    for _ in range(400):
        n, same = 200, int(rng.integers(172, 178))
        x = np.unique(rng.integers(0, 2**63, 3 * n, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(np.concatenate((x[:same], x[n : 2 * n - same])))
        met += bool(np.isin(sketcher.keys(a), sketcher.keys(b)).any())
    assert met == 400
