import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import infill
from sql_rows import same_rows

LINES = [(i, "".join(f"l{k} é😀\n" for k in range(i)) + ("" if i % 2 else "tail"), "en") for i in range(40)]


def by_hand(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"rate": 50, "spm": 0}])
def test_cuts_by_hand(spark, options):
    df = spark.createDataFrame(LINES, "doc_id long, text string, lang string")
    out = infill.fill_in_middle(df, **options)
    want = {i: by_hand(i, t, options.get("rate", 100), options.get("spm", 50)) for i, t, _ in LINES}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()}
    assert got == want
    assert {v[1] for v in got.values()} >= ({"plain", "psm"} if options.get("rate") else {"psm", "spm"})


def test_restored_whatever_stands_at_the_cuts(spark):
    rows = [(i, "<\n<S\n><P\nP>\n<M\n<<\nM>" * (1 + i % 3)) for i in range(60)] + [(99, "a<P>\nb")]
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    out = out.select("row.text", infill.restored(F.col("output"), F.col("form")).alias("back"), "form")
    assert out.filter("back <=> text").count() == 61 and out.filter("form = 'plain'").count() == 1


def test_odd_rows(odd, none):
    out = infill.fill_in_middle(odd, block=100)
    assert sorted((str(r.row.doc_id), r.row.text or "", r.form, r.output) for r in out.collect()) == sorted((str(r.doc_id), r.text or "", *by_hand(r.doc_id, r.text or "")[1::3]) for r in odd.collect())
    assert infill.fill_in_middle(none).count() == 0
    dotted = odd.withColumnRenamed("lang", "key").withColumnRenamed("size", "a.b").withColumn("first_end", F.lit(1))
    assert infill.fill_in_middle(dotted).select("row.*").columns == dotted.columns


def test_long_text_of_many_lines(spark):
    text = "x\n" * 30_000 + "y" * 100_000
    out = infill.fill_in_middle(spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string"))
    assert [tuple(r)[2:] for r in out.collect()] == [by_hand(5, text)] * 2


def test_same_rows_as_sql(spark):
    same_rows(spark, "op11_fill_in_middle")
