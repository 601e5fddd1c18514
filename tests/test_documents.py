import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import documents as d

PAPER = """A Study of Nets
Ann Lee, Bo Ray

Abstract
We study nets. They work.

1 Introduction
Nets are known.

2 Methods
We cut the data in two.

Table 2 Accuracy BLEU
3.1 Experimental Setup
All runs use one card.

4 R ESULTS AND DISCUSSION
Nets reach 91 percent.

5 Conclusion
Nets are fine.

References
[1] A. Author. Prior Study. 2020.
2 Methods
"""


def test_sections_of_a_paper(spark):
    df = spark.createDataFrame([(1, PAPER), (2, None), (3, " \n"), (4, "no heading here"), (5, "Abstract\n\n1 Introduction\r\nText.")], "id int, text string")
    rows = d.sections(df, "id", "text").orderBy("id", "number").collect()
    assert [(r.section_type, r.title) for r in rows if r.id == 1] == [
        ("TITLE", "Document header"), ("ABSTRACT", "Abstract"), ("INTRODUCTION", "1 Introduction"), ("METHODS", "2 Methods"), ("EXPERIMENTAL_SETUP", "3.1 Experimental Setup"),
        ("RESULTS", "4 R ESULTS AND DISCUSSION"), ("CONCLUSION", "5 Conclusion"), ("REFERENCES", "References"),
    ]
    assert all(PAPER[r.start : r.end].strip() == r.text for r in rows if r.id == 1) and "Table 2" in rows[3].text
    assert [(r.id, r.section_type, r.text) for r in rows if r.id > 1] == [(4, "TITLE", "no heading here"), (5, "ABSTRACT", "Abstract"), (5, "INTRODUCTION", "1 Introduction\r\nText.")]


@pytest.mark.parametrize(("line", "heading"), [
    ("Abstract", True), ("abstract:", True), ("2.3 D ATASET CONDENSATION WITH MATCHING", True), ("IV. Approach", True), ("Model Architecture and Training", True), ("Table 2 Accuracy", False), ("Figure 3. Model", False), ("[12] Smith J. Paper", False),
    ("It improves.", False), ("Ann Lee, Bo Ray", False), ("Experiments on two tasks show it", False), ("1. Smith, J", False), ("3 lower case", False), ("", False), ("4 " + "Word " * 11, False), ("5 " + "X" * 99, False),
])
def test_headings(spark, line, heading):
    assert spark.createDataFrame([(line,)], "t string").select(d.is_heading(F.col("t"))).first()[0] is heading


def prefix(text, limit):
    if len(text) <= limit:
        return text
    kept, used = [], 0
    for p in [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]:
        used += len(p) + (2 if kept else 0)
        if used > limit:
            break
        kept.append(p)
    if kept:
        return "\n\n".join(kept)
    used = 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        used += len(s) + (1 if kept else 0)
        if used + 1 > limit:
            break
        kept.append(s.strip())
    return " ".join(kept)


def by_hand(sections, total):
    """The selected sections of (type, start, text), in the order of the text."""
    rank = lambda s: (0 if s[0] == "TITLE" else 1 if s[0] in d.HIGH else 2 if s[0] == "OTHER" else 3, s[1])
    rest, kept = total, []
    for s in sorted((s for s in sections if s[0] != "REFERENCES"), key=rank):
        if rest <= 0:
            break
        cut = prefix(s[2], min(4000, rest) if s[0] == "TITLE" else rest)
        if cut:
            kept.append((s[0], s[1], cut))
            rest -= len(cut)
    return sorted(kept, key=lambda s: s[1])


def some_papers(seed=1):
    rng = random.Random(seed)
    heads = ["Abstract", "1 Introduction", "2 Related Work", "3 Methods", "4 Other Matters", "5 Results", "Conclusion", "References"]
    body = lambda: "\n\n".join(" ".join("word " * rng.randrange(1, 9) + "end." for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 5)))
    return [(i, "\n\n".join(h + "\n" + body() for h in heads if rng.random() < 0.8) or "x") for i in range(40)]


@pytest.mark.parametrize("total", [60, 300, 900, 5000])
def test_budget_by_hand(spark, total):
    df = spark.createDataFrame(some_papers(), "id int, text string")
    of = {}
    for r in d.sections(df, "id", "text").collect():
        of.setdefault(r.id, []).append((r.section_type, r.start, r.text))
    rows = d.prepare(df, "id", "text", total=total, most=400, chunk=300, overlap=40).collect()
    assert {True, False} >= {r.fallback for r in rows} and not all(r.fallback for r in rows)
    for r in rows:
        if not r.fallback:
            assert [(s.section_type, s.start, s.text) for s in r.selected] == by_hand(of[r.id], total)
            assert r.selected_characters == sum(len(s.text) for s in r.selected) <= total
        assert r.chunks_created == len(r.chunks) and r.input_characters == sum(map(len, r.chunks))


def test_chunks_keep_paragraphs_and_labels(spark):
    r = d.prepare(spark.createDataFrame([(1, PAPER)], "id int, text string"), "id", "text", total=10_000, most=600, chunk=550, overlap=0).first()
    assert r.sections_detected == 8 and "REFERENCES" not in [s.section_type for s in r.selected]
    both = "\n".join(r.chunks)
    assert "[METHODS: 2 Methods]\n2 Methods\nWe cut the data in two." in both and "Prior Study" not in both and all(len(c) <= 600 for c in r.chunks)


def test_fallback_and_empty_texts(spark):
    rows = {r.id: r for r in d.prepare(spark.createDataFrame([(1, "plain text. " * 400), (2, None), (3, "  ")], "id int, text string"), "id", "text", total=1000, most=700, chunk=600, overlap=0).collect()}
    assert rows[1].fallback and [s.priority for s in rows[1].selected] == ["FALLBACK"] and rows[1].chunks_created > 1 and len(rows[1].selected[0].text) <= 1000
    assert rows[2].chunks == rows[3].chunks == [] and rows[2].total_characters == 0
    with pytest.raises(ValueError):
        d.prepare(spark.createDataFrame([], "id int, text string"), "id", "text", chunk=10, overlap=10)
