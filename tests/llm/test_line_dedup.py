import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import line_dedup
from quillstone.llm.line_dedup import LineIndex, dedup_lines, drop_lines


def brute(rows):
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        out[d] = (len(lines), "\n".join(x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == d))
    return out


def found(df):
    return {r.doc_id: (r.n_lines, r.text) for r in df.collect()}


def state(index):
    return {(r.k1, r.k2): (r.n, r.first, r.last) for r in index.totals().collect()}


def test_whole_table(docs):
    assert found(dedup_lines(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_insertions_and_deletions_undo_each_other(docs):
    docs = docs.filter("doc_id < 120").select("doc_id", "text")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    one = LineIndex.empty(docs.sparkSession).insert(first)
    both = one.insert(second)
    assert found(drop_lines(docs, both)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert both.refs.count() == both.insert(first).refs.count()
    back = both.delete(second)
    assert state(back) == state(one)
    assert back.lookup(one.counts).filter("not seen").count() == 0
    gone = both.counts.join(one.counts, ["k1", "k2"], "left_anti")
    assert gone.count() > 50
    assert back.lookup(gone).filter("seen").count() <= 1
    assert found(drop_lines(first, back)) == brute([(r.doc_id, r.text) for r in first.collect()])


def test_full_filters_are_built_anew(docs, monkeypatch):
    small, large = docs.filter("doc_id < 10"), docs.filter("doc_id >= 10 and doc_id < 150")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10**6)
    index = LineIndex.empty(docs.sparkSession).insert(small).insert(large)
    assert index.shards == 1
    assert index.lookup(index.counts).filter("not seen").count() == 0


def test_shards_double_with_the_keys(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    index = LineIndex.empty(docs.sparkSession)
    shards = [1]
    for k in range(3):
        index = index.insert(docs.filter(f"doc_id % 3 = {k}"))
        shards.append(index.shards)
    assert shards[1] < shards[3] and index.keys == index.totals().count() <= 50 * index.shards
    assert index.lookup(index.totals()).filter("not seen").count() == 0
    assert found(drop_lines(docs, index)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    # A batch taken out and put in again leaves no trace.
    again = index.delete(docs.filter("doc_id % 3 = 1")).insert(docs.filter("doc_id % 3 = 1"))
    assert state(again) == state(index) and again.keys == index.keys


def test_what_the_filters_answer_decides(docs, monkeypatch):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(dedup_lines(docs)) == want
    # A filter that knows everything costs lookups and changes nothing; one that knows nothing loses counts.
    index = LineIndex.empty(docs.sparkSession).insert(docs.filter("doc_id % 2 = 0"))
    for answer, right in ((True, True), (False, False)):
        monkeypatch.setattr(line_dedup.CuckooFilter, "contains", (lambda a: lambda self, k1, k2: np.full(k1.size, a))(answer))
        got = found(drop_lines(docs, index.insert(docs.filter("doc_id % 2 = 1"))))
        assert (got == want) is right


def test_odd_rows(spark, odd, none):
    rows = spark.createDataFrame(
        [(1, "Some Line Here\nshort\n\n"), (1, "some line here"), (2, " some line here\t\nother"), (None, "some LINE here"), (3, None), (4, ""), (5, "ééééééééé"), (6, "ééééééééé"), (7, "éééééééééé"), (8, "éééééééééé")],
        "doc_id long, text string",
    )
    got = sorted((r.doc_id or 99, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(rows).collect())
    assert got == [
        (1, 1, 0, "some line here"), (1, 4, 0, "Some Line Here\nshort\n\n"), (2, 2, 1, "other"), (3, 1, 0, ""), (4, 1, 0, ""),
        (5, 1, 0, "ééééééééé"), (6, 1, 0, "ééééééééé"), (7, 1, 0, "éééééééééé"), (8, 1, 1, ""), (99, 1, 1, ""),
    ]
    assert dedup_lines(odd).count() == 10
    assert dedup_lines(none).count() == 0
    assert line_dedup.postings(odd).agg(F.count("*")).first()[0] > 0
