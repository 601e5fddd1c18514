"""Queries that leave no rows out, against plain versions and, where they have it, their SQL."""

import re

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def test_nearest_item_of_every_document(spark, tmp_path):
    long, far = "alpha beta gamma delta " * 100, " ".join(f"word{i}" for i in range(400))
    docs = [(1, long, len(long)), (2, "alpha beta gamma other", None), (3, far + " alpha beta", len(far) + 11), (4, "", 0), (5, None, None), (6, "one two three", 13)]
    items = [(7, "alpha beta gamma delta"), (8, "one two three four five"), (9, "one two three five four"), (10, "")]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) >= 3}
    want = []
    for doc_id, text, _ in docs:
        pairs = [(round(len(words(text) & words(t)) / len(words(text) | words(t)), 4), -i) for i, t in items if words(text) | words(t)]
        score, item = max(pairs, default=(0, 0))
        if score >= 0.15:
            want.append((doc_id, -item, score))
    got = _rows(entry.queries()["jn03_nearest"](spark, str(tmp_path)))
    assert got == want == [(1, 7, 1.0), (2, 7, 0.6), (6, 8, 0.6)]


def test_redaction_of_every_document(spark, tmp_path):
    docs = [(1, "password: x"), (2, "API_KEY = 'a b', secret=\"c d\""), (3, "my_token = e f"), (4, "nothing"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, "password=[REDACTED]"), (2, "API_KEY=[REDACTED], secret=[REDACTED]"), (3, "my_token=[REDACTED] f"), (4, "nothing"), (5, None)]
    assert _rows(entry.queries()["sc14_redact"](spark, str(tmp_path))) == want
    assert _rows(entry.queries()["sc14_redact"](spark, SF)) == _by_sql("sc14_redact")


def test_newest_case_of_every_part(spark):
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    known, want = {r.p_partkey for r in parts.collect()}, {}
    for r in lines.collect():
        if r.l_partkey in known:
            want[r.l_partkey] = max(want.get(r.l_partkey, r.l_orderkey), r.l_orderkey)
    got = _rows(entry.queries()["jn26_newest_case"](spark, SF))
    assert got == sorted(want.items(), key=repr) == _by_sql("jn26_newest_case")
    assert any(p % 20 for p in want)
