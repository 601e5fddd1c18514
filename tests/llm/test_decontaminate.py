import random

import numpy as np

from quillstone.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def test_planted_items(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in bench if t in r.text or t.upper() in r.text}
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()} == want
    assert d.drop_leaks(docs, items).count() == docs.count() - len({x for x, _ in want})


def test_search_finds_all_above_the_threshold():
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6))}".encode() for _ in range(4000)]
    items = [(i, [rng.choice(words) for _ in range(rng.randrange(3, 60))]) for i in range(150)]
    index = d.Index(items)
    df = {t: sum(t in w for _, w in items) for t in index.vocabulary}
    mean = np.mean([len(w) for _, w in items])

    def score(item, passage):
        s = lambda terms: sum(np.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * (f := item.count(t)) * (d.K1 + 1) / (f + d.K1 * (1 - d.B + d.B * len(item) / mean)) for t in terms)
        return s(set(item) & passage) / s(set(item))

    for _ in range(200):
        base = list(rng.choice(items)[1])
        passage = set(rng.sample(base, rng.randrange(1, len(base) + 1)) + rng.sample(words, 30)) & set(index.vocabulary)
        terms = np.array(sorted(index.vocabulary[t] for t in passage))
        want = {i for i, w in items if score(w, passage) >= d.THRESHOLD}
        assert set(index.search(terms)[0].tolist()) == want
        # The bound that skips passages never skips one that holds an item.
        assert not want or index._passing(terms, np.zeros(terms.size, int), 1).tolist() == [0]


def test_long_documents_and_items(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    items = [(1, " ".join(word() for _ in range(12))), (2, " ".join(word() for _ in range(400))), (3, "one"), (4, None), (5, "...")]
    text = [" ".join(word() for _ in range(3000)) for _ in range(4)]
    docs = [(1, text[0] + " " + items[0][1].upper() + " " + text[1]), (2, text[2] + " " + items[1][1].replace(" ", ", ")), (3, text[3]), (4, None), (5, ""), (6, items[0][1][:30])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(df, bench).collect()} == {(1, 1), (2, 2)}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a b c d e f g h", "x"), (None, None, "x"), (2, "", "x")], "item_id long, text string, doc_id string")
    assert sorted((r.doc_id or 0) for r in d.find_leaks(odd, bench).collect()) == [0, 1, 5, 5]
    assert d.find_leaks(none, bench).count() == 0 and d.find_leaks(odd, bench.filter("false")).count() == 0
    assert d.drop_leaks(odd, bench).columns == odd.columns and d.drop_leaks(odd, bench).count() == 6


def test_cutting_into_shards_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(800)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(34, 60)))) for i in range(24)]
    edited = lambda t, n: " ".join(["new"] * n + t.split()[n:])
    text = lambda: " ".join(rng.choice(words) for _ in range(100))
    docs = [(i, f"{text()} {edited(t, i % 9)} {text()}") for i, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = d.Index([(i, d.terms_of(t)) for i, t in items])
    plain = lambda rows: sorted((a, b, *(round(x, 9) for x in found)) for a, b, *found in rows)
    want = plain((doc_id, index.ids[i], *found) for doc_id, t in docs for i, found in index.matches(d.terms_of(t)).items())
    assert len(want) >= 16 and sum(score < 0.99 for _, _, score, *_ in want) >= 8
    assert plain(d.find_leaks(df, bench.union(bench)).collect()) == want
    monkeypatch.setattr(d, "SHARD_ITEMS", 6)
    assert len(list(d.shards(bench))) > 2 and len(list(d.passes(bench))) == 1
    assert plain(d.find_leaks(df, bench).collect()) == want
    monkeypatch.setattr(d, "PASS_POSTINGS", 1)
    assert len(list(d.passes(bench))) == len(list(d.shards(bench)))
    assert plain(d.find_leaks(df, bench).collect()) == want
