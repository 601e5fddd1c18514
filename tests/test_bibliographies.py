import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import bibliographies as b
from quillstone.functions.citations import unmerged


def split(spark, *texts, by=b.author_date_references):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in by(df, "id", "text").orderBy("id", "number").collect():
        out.setdefault(r.id, []).append(r.raw)
    return [out.get(i, []) for i in range(len(texts))]


def test_shapes_of_author_date_bibliographies(spark):
    dated = (
        "Berg, Ida, Rolf Carsen, and Ester Del Rio. 2013. “Logs reveal users.” Journal of Shelves 7 (4):389–400. http://dx.doi.org/10.1080/193.2013.82.\n"
        "Bell, Pia. 2009. “Assessing collections.” Journal of Shelves 21 (1):75. http://dx.doi.org/10.1080/194.\n"
        "Google. n.d.a. About the flow reports. https://support.example.com/answer/2519986.\n"
        "Lund, Wim. 2012. “Showing success.” Journal of Shelves 6 (1):45–55. http://dx.doi.org/10.1080/193.2012.65.\n"
    )
    wrapped = (
        "Arno Agassi, Lena Zettel, and Sona Gupte. Inner dimensions explain the\nworth of tuning. arXiv:2012.13255 [cs], December 2020. URL\nhttp://arxiv.org/abs/2012.13255.\n"
        "Zoe Allen and Yuan Lin. What can nets learn, going beyond kernels? In\nProceedings, 2019. Full version at http://arxiv.org/abs/1905.10337.\n"
        "Jim Lee Bo, Jamie Ryan Kos, and Geoff E. Hill. Layer norms, 2016.\n"
    )
    inline = (
        "Geoff Hill, Oriol Vin, and Jeff Den. Distilling what a net knows, 2015. Jon J. Hall. A base of written digits. IEEE Transactions on Patterns, 16(5):550-554, 1994.\n"
        "Rico Hen. A study shown at a meeting in 2009.\nIEEE Conference on, pp. 1-8. Ieee, 2009. Just Dome. Generic ways of tuning. In Meetings, 2012."
    )
    headed = "Ann Lee. One thing. In Notes, 2001.\n17\nJOURNAL OF SHELVES 175\nBob Ray. Other thing. In Notes, 2002."
    got = split(spark, dated, wrapped, inline, headed, None, " \n ", "too short")
    assert [len(g) for g in got] == [4, 3, 4, 2, 0, 0, 0]
    assert [g.split()[0] for g in got[0]] == ["Berg,", "Bell,", "Google.", "Lund,"]
    assert got[1][0].endswith("http://arxiv.org/abs/2012.13255.") and got[1][2].startswith("Jim Lee Bo")
    assert got[2][1].startswith("Jon J. Hall") and "IEEE Conference" in got[2][2] and got[2][3].startswith("Just Dome")
    assert got[3] == ["Ann Lee. One thing. In Notes, 2001.", "Bob Ray. Other thing. In Notes, 2002."]


PIECES = ["Ann Lee. One", "Bo Ray, Cy Dee, and Ed Fox. Two", "more of it", "at http://x.org/1 see", "In Notes, 2001.", "no. 17.", "as 12", "Kim, Lou. 1999. Three.", "part b.", "12", "http://arxiv.org/abs/1.2.", "Zed, Al", "page 12345"]


def plain_reading(lines):
    """The second reading, line by line."""
    lines = [x for x in lines if not re.fullmatch(r"\d{1,3}", x)]
    entries = []
    for x in lines:
        first = x.split(",")[0].split(" and ")[0].strip()
        author = bool(re.match(b.ONE_AUTHOR[4:], x)) or ("," in x or " and " in x) and 2 <= len(first.split()) <= 7 and first[:1].isupper() and not re.search(r"\d", first)
        held = " ".join(entries[-1]) if entries else ""
        complete = bool(re.search(b.COMPLETE[4:], held)) or bool(re.search("https?://", held)) and bool(re.search(r"\d+\.\s*$", held))
        if entries and author and complete:
            entries.append([x])
        elif entries:
            entries[-1].append(x)
        else:
            entries = [[x]]
    return [" ".join(e) for e in entries if len(" ".join(e)) > 15]


def plain_first(lines):
    entries = []
    for k, x in enumerate(lines):
        starts = any(re.match(p.replace("(?U)", "").replace("(?iU)", "(?i)"), x) for p in (b.DATED_AUTHOR, b.CORPORATE_AUTHOR, b.INVERTED_AUTHOR))
        before = lines[k - 1] if k else ""
        if k and starts and (re.search(b.ENDED[4:], before) or re.search(b.LINKED.replace("(?iU)", "(?i)"), before)):
            entries.append([x])
        elif entries:
            entries[-1].append(x)
        else:
            entries = [[x]]
    return [" ".join(e) for e in entries if len(" ".join(e)) > 15]


def test_both_readings_line_by_line(spark):
    rng = random.Random(5)
    texts = [[rng.choice(PIECES) for _ in range(rng.randrange(1, 14))] for _ in range(400)]
    got = split(spark, *["\n".join(t) for t in texts])
    run_on = re.compile(b.RUN_ON[4:])
    seen = set()
    for t, g in zip(texts, got, strict=True):
        lines = [x.strip() for x in run_on.sub(r"\1\n", "\n".join(t)).splitlines()]
        one, two = plain_first(lines), plain_reading(lines)
        assert g == (two if len(two) > len(one) else one), t
        seen.add(len(two) > len(one))
    assert seen == {True, False}


@pytest.mark.parametrize(("text", "strategy", "count"), [
    ("[1] Ann Lee, One thing of note.\n[2] Bo Ray, Other thing of note.", "numbered", 2),
    ("[1] Ann Lee, One thing of note, x. [2] Bo Ray, Other thing of note. [1 3] Cy Dee, Last thing.", "numbered", 3),
    ("1. Ann Lee, One thing of note. 2. Bo Ray, Other thing of note. 3. Cy Dee, Last thing.", "numbered", 3),
    ("5. Ann Lee, One thing of note. 7. Bo Ray, Other thing of note.", "loose", 1),
    ("(1) Ann Lee, One thing of note.\n(2) Bo Ray, Other thing of note.", "numbered", 2),
    ("Ann Lee. One thing. In Notes, 2001.\nBob Ray. Other thing. In Notes, 2002.", "author_date", 2),
    ("one thing that is of note\n\nother thing that is of note", "loose", 2),
    ("one thing of some note; other thing of some note; x", "loose", 2),
    ("one thing that is of some note\nother thing that is of some note", "loose", 2),
])
def test_strategies(spark, text, strategy, count):
    rows = b.manuscript_references(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, text string"), "id", "text").collect()
    assert [(r.id, r.strategy, r.number) for r in sorted(rows, key=lambda r: r.number)] == [(1, strategy, k + 1) for k in range(count)]


def test_author_year_text(spark):
    body = (
        "Some studies looked at logs (Berg et al. 2013, 392). Tanner (2010) named the signs. Others noted joy (Fagan 2014; Lund 2012, 47). "
        "Google tells of it (Google n.d.a). Table (2010) and Figure (2011) show it."
    )
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "see (1), and in Eq. (2) or (2016)")], "id int, body string")
    rows = b.scan_markers(df, "id", "body").filter("id = 1").orderBy("place").collect()
    assert [(r.form[12:], r.marker) for r in rows] == [("PARENTHETICAL", "(Berg et al. 2013, 392)"), ("PARENTHETICAL", "(Fagan 2014; Lund 2012, 47)"), ("PARENTHETICAL", "(Google n.d.a)"), ("NARRATIVE", "Tanner (2010)")]
    assert all(body[r.start : r.end] == r.marker for r in rows)
    assert {r.id: r.style for r in b.citation_styles(df, "id", "body").collect()} == {1: "AUTHOR_YEAR", 2: "UNKNOWN", 3: "UNKNOWN", 4: "UNKNOWN"}


def test_notes_and_superscripts(spark):
    body = "One¹ two²⁻ three³,⁴ [Note] see it [FOOTNOTE] 12. that one\n(7) " + "x" * 130 + " (1900)"
    rows = b.scan_markers(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").orderBy("start").collect()
    assert [(r.family, r.marker, r["keys"]) for r in rows] == [
        ("NUMERIC_SUPERSCRIPT", "¹", [1]), ("NUMERIC_SUPERSCRIPT", "²", [2]), ("NUMERIC_SUPERSCRIPT", "³,⁴", [3, 4]),
        ("FOOTNOTE_NOTE", "[Footnote]", [1]), ("FOOTNOTE_NOTE", "[12]", [12]), ("NUMERIC_PARENTHETICAL", "(7)", [7]),
    ]


def test_no_line_leaves_its_text(spark):
    df = spark.range(3).selectExpr("id", "concat('Ricardo Lee. A study of it by\\nmany. In Proceedings 1, 199', id, '.') AS text")
    for split_ in (b.author_date_references, b.manuscript_references):
        plan = split_(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Exchange|Window|Join|Aggregate", plan), split_


def test_each_text_is_read_once(spark):
    # A reading that names what it made more than once does not make it again: patterns stand in the plan once for each place that reads them.
    df = spark.createDataFrame([(1, "x")], "k long, t string")
    plan = b.manuscript_references(df, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (b.COMPLETE, b.ONE_AUTHOR, b.STRATEGIES[0][2]):
        assert plan.count(pattern) == 1
    plan = df.select(unmerged(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?<=\[[\d\s]{0,40})") == 1


def test_ends_of_lines_tell_as_whole_lines_do(spark):
    ends = ["2004.", "12004a.", "x 1999b. ", "see a.", "A.", "ba.", "123456789.", "3.", "12.", "http://arxiv.org/abs/1 2.", "doi.org/10.1/x", "doi.org/", "page.html", ".htm", "99999", "1234", "end)", "end”", "…", "é2001.", "𝟐𝟎𝟎𝟏."]
    lines = [(start + e).strip() for start in ("", "A long line of words that goes before it ", "https://doi.org/10.1000/", "word") for e in ends]
    whole = b.COMPLETE + "|" + b.COMPLETE_LINK.replace("(?iU)", "(?iU:") + ")"
    line, tail = F.col("line"), b._tail(F.col("line"))
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(
        line, (line.rlike(whole) == (tail.rlike(b.COMPLETE) | (line.contains("/") & line.rlike(b.COMPLETE_LINK)))).alias("complete"), (line.rlike(b.ENDED) == tail.rlike(b.ENDED)).alias("ended"), (line.rlike(b.NUMBER_AT_END) == tail.rlike(b.NUMBER_AT_END)).alias("number")
    )
    assert rows.filter("not (complete and ended and number)").collect() == []
    assert rows.count() == len(lines)
