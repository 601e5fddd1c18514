"""Bounded texts, dependency files and rules on cases of their own."""

import re

from pyspark.sql import functions as F

from quillstone.functions import context, dependencies, rules


def _each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_large_texts_are_cut_at_the_widest_break(spark):
    assert _each(spark, ["short", None, ""], lambda c: context.large_text(c, 20)) == [["short"], [""], [""]]
    paragraphs = "First part here.\n\n  Second part, a bit longer. It has two.\n \nThird"
    assert _each(spark, [paragraphs], lambda c: context.large_text(c, 30)) == [["First part here.", "Second part, a bit longer.", "It has two.", "Third"]]
    lines = "one line of words\nand another line\nend"
    assert _each(spark, [lines], lambda c: context.large_text(c, 20)) == [lines.split("\n")]
    no_break = "aaaa bbbb cccc dddddddddddddddddddd ee"
    assert _each(spark, [no_break], lambda c: context.large_text(c, 10)) == [["aaaa bbbb", "cccc", "d" * 9, "d" * 10, "d ee"]]  # the blank before a long word counts


def test_large_texts_lose_no_word(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, pieces in zip(texts, _each(spark, texts, lambda c: context.large_text(c, 300)), strict=True):
        assert [w for p in pieces for w in p.split()] == text.split() or any(len(w) > 200 for w in text.split())
        assert all(len(p) <= 300 or len(re.split(r"(?<=[.!?])\s+", p)) == 1 for p in pieces)


def test_bounded_texts(spark):
    text = "\n\n".join(f"Paragraph {i} has some words in it." for i in range(40))
    [out] = _each(spark, [text], lambda c: context.bounded_text(c, 300))
    assert out.startswith("Paragraph 0 has") and out.endswith("Paragraph 39 has some words in it.") and len(out) <= 302
    assert _each(spark, ["short", None], lambda c: context.bounded_text(c, 300)) == ["short", ""]
    [one] = _each(spark, ["A sentence of words. " * 30], lambda c: context.semantic_prefix(c, 100))
    assert one == " ".join(["A sentence of words."] * 4)


def test_reference_fields(spark):
    raw = ["[3] B. Ohm, Cy Moe, and D. E. Poe. On  things of\nnote. Venue, 2001.", "Ann Ba, Bo Ce. Do wide- range nets learn? Yes. Venue.", "Lone Title. Venue.", None, "[1] x"]
    got = _each(spark, raw, context.reference_fields)
    assert [(r.title, r.authors) for r in got] == [("On things of note", ["B. Ohm", "Cy Moe", "D. E. Poe"]), ("Do widerange nets learn?", ["Ann Ba", "Bo Ce"]), (None, []), (None, []), (None, [])]


def test_requirement_lines(spark):
    lines = ["torch>=2, <3  # why", "a[b,c]==1 ; python_version<'3'", "x @ https://e.org/x.whl", "-r other", "git+https://e.org/y", "two words", "", None, "plain"]
    got = [r and (r.name, r.version_constraint) for r in _each(spark, lines, dependencies.requirement)]
    assert got == [("torch", ">=2,<3"), ("a", "[b,c]==1; python_version<'3'"), ("x", "@ https://e.org/x.whl"), None, None, None, None, None, ("plain", None)]


def test_unreadable_files_declare_nothing(spark):
    for file in dependencies.FORMATS:
        assert _each(spark, ["[[[", None, ""], lambda c, f=file: dependencies.declared(c, f)) == [[], [], []]
    assert _each(spark, [None, "dependencies:\n - a\nother:\n - b"], dependencies.conda)[0] == []
    assert [r.name for r in _each(spark, ["dependencies:\n - a\nother:\n - b"], dependencies.conda)[0]] == ["a"]


def test_commands_and_files(spark):
    df = spark.createDataFrame([("sh Run.sh", ["src/run.sh"]), ("python a/run.py", ["b/run.py"]), ("make all", ["x"]), ("python b/run.py x.sh", ["b/run.py"])], "c string, p array<string>")
    assert [r.x for r in df.select(rules.fits_files(F.col("c"), F.col("p")).alias("x")).collect()] == [True, False, True, True]
