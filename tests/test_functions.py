import pytest
from pyspark.sql import functions as F

from quillstone.functions import citations, fuzzy, identifiers, ladders, text
from quillstone.operators import aggregates


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lcs_ratio():
    assert fuzzy.lcs("kitten", "sitting") == 4
    assert fuzzy.lcs("", "abc") == 0
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("", "") == 100
    assert fuzzy.token_sort("b a", "a b") == 100
    assert fuzzy.token_set("a b c", "c a") == 100
    assert fuzzy.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100


@pytest.mark.parametrize(("raw", "want"), [("1-4, 7, 9-11", [1, 2, 3, 4, 7, 9, 10, 11]), ("3", [3]), ("5-100", [5, 100]), ("2 – 4", [2, 3, 4]), ("", [])])
def test_unroll(spark, raw, want):
    assert one(spark, identifiers.unroll(F.lit(raw)))[0] == want


@pytest.mark.parametrize(("raw", "want"), [
    ("https://doi.org/10.1000/ABC.", "10.1000/ABC"), ("doi: 10.1016/j.x(2020)01)", "10.1016/j.x(2020)01"), ("10.12/short", None),
    ("DOI:10.1109/5.771073,", "10.1109/5.771073"), ("http://dx.doi.org/10.1000/xyz];", "10.1000/xyz"),
])
def test_doi_normal(spark, raw, want):
    assert one(spark, identifiers.doi_normal(F.lit(raw)))[0] == want


def test_doi_repair(spark):
    assert one(spark, identifiers.doi_repair(F.lit("doi: l0.1O16/j.ab c.2020 Authorized licensed use")))[0] == "10.1016/j.abc.2020"


@pytest.mark.parametrize(("raw", "want"), [
    ("https://arxiv.org/abs/1012.100001", "10.48550/arXiv.1012.100001"), ("https://arxiv.org/pdf/1706.03762v5", "10.48550/arXiv.1706.03762"), ("arXiv: 0704.0001", "10.48550/arXiv.0704.0001"), ("https://x.org/1012.10001", None),
])
def test_preprint_doi(spark, raw, want):
    assert one(spark, identifiers.preprint_doi(F.lit(raw)))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("Smith J.", ("smith", "j")), ("Smith, John", ("smith", "j")), ("J. Smith", ("smith", "j")), ("Prathap G.", ("prathap", "g")), ("Plato", ("plato", "")), ("", ("", ""))])
def test_author_parts(spark, raw, want):
    assert tuple(one(spark, text.author_parts(F.lit(raw)))[0]) == want


def test_titles(spark):
    s = lambda a, b: one(spark, fuzzy.title_similarity(F.lit(a), F.lit(b)))[0]
    assert s("Attention is all you need", "ATTENTION is all you need!") == 1
    assert s("", "x") == 0
    assert s("A survey of graph neural networks", "A survey of graph neural networks in biology") >= 0.9
    assert s("Deep learning for images", "Medieval trade routes") < 0.4


def test_authors(spark):
    s = lambda a, b: one(spark, fuzzy.author_similarity(F.lit(a), F.lit(b)))[0]
    assert s("Smith, J.; Doe, A.", "Smith J.; Doe A.") == 1
    assert s("Smith, J.", "Jones, B.") == 0


def test_composite_is_renormalised(spark):
    n = F.lit(None).cast("double")
    assert one(spark, fuzzy.composite(F.lit(1.0), F.lit(1.0), n, n, n))[0] == 1
    assert one(spark, fuzzy.composite(F.lit(1.0), n, F.lit(0.0), n, n))[0] == pytest.approx(0.40 / 0.55, abs=1e-4)


def test_split_references(spark):
    raw = "Prathap G.; Gupta B.M., Ranking of Indian universities, Curr. Sci, 97, 6, pp. 751-752, (2009); Gupta B.M., Ranking and performance, 3, 7, pp. 837-843, (2010);"
    got = one(spark, citations.split_references(F.lit(raw)))[0]
    assert len(got) == 2 and got[0].raw.startswith("Prathap G.; Gupta B.M.")
    assert [one(spark, citations.reference_year(F.lit(r.raw)))[0] for r in got] == [2009, 2010]
    assert one(spark, citations.split_references(F.lit("left over")))[0][0].reasons[0] == "TRAILING_REMAINDER_NO_CLOSING_YEAR"
    assert one(spark, citations.split_references(F.lit(None).cast("string")))[0] == []


def test_split_bibliography(spark):
    numbered = "[1] Smith J. A work of note, 2001.\n[2] Doe A. Another work of note, 2002."
    assert len(one(spark, citations.split_bibliography(F.lit(numbered)))[0]) == 2
    inline = "[1] Smith J. A work of note, 2001. [2] Doe A. Another work of note, 2002."
    assert len(one(spark, citations.split_bibliography(F.lit(inline)))[0]) == 2


def test_quoted_title(spark):
    r = one(spark, citations.citation_fields(F.lit('[3] A. Vaswani, "Attention is all you need," NeurIPS, vol. 30, pp. 5998-6008, 2017.')))[0]
    assert (r.cited_title, r.cited_year, r.cited_pages, r.cited_volume) == ("Attention is all you need", 2017, "5998-6008", "30")


def test_consistency(spark):
    a = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    r = one(spark, aggregates.consistency(a([1, 2, 3, 4, 5, 6, 8]), a([1, 2, 3, 4, 5, 6, 8, 9])))[0]
    assert (r.orphans, r.missing, r.gaps) == ([9], [], [7])


def test_recency(spark):
    df = spark.createDataFrame([("d", y, 2026) for y in (2025, 2024, 2022, 2018, 2010)], "k string, y int, b int")
    r = aggregates.recency(df, "k", "y", "b").first()
    assert (r.recency_index, r.median_age) == (60.0, 4.0)


@pytest.mark.parametrize(("c", "t", "a", "y", "http", "exists", "resolves", "want"), [
    (0.95, 0.98, 0.9, True, 200, True, True, ("VALID_CORRECT", "HIGH")), (0.15, 0.10, 0.0, False, 200, True, True, ("VALID_DOI_WRONG_REFERENCE", "HIGH")),
    (0.0, 0.0, 0.0, False, 404, False, False, ("INVALID_DOI", "HIGH")), (0.90, 0.92, 0.9, True, 403, True, True, ("ACCESS_RESTRICTED", "HIGH")),
])
def test_decisions(spark, c, t, a, y, http, exists, resolves, want):
    lit = F.lit
    r = one(spark, ladders.with_identifier(lit(c), lit(t), lit(a), lit(y), lit(exists), lit(resolves), lit(http), lit(0), lit(False)))[0]
    assert (r.final_status, r.confidence) == want


@pytest.mark.parametrize(("c", "t", "a", "doi", "want"), [(0.92, 0.95, 0.9, "10.1/x", "DOI_RECOVERED"), (0.80, 0.99, 0.75, "10.1/x", "DOI_RECOVERED"), (0.64, 1.0, 0.37, "10.1/x", "DOI_RECOVERED"), (0.9, 0.9, 0.9, "", "DOI_MISSING")])
def test_recovered(spark, c, t, a, doi, want):
    lit = F.lit
    assert one(spark, ladders.recovered_identifier(lit(c), lit(t), lit(a), lit(True), lit(doi)))[0].final_status == want


def test_logistic(spark):
    ones = {k: F.lit(1.0) for k in fuzzy.LOGISTIC}
    assert one(spark, fuzzy.probability(ones | {"is_restricted": F.lit(0.0), "is_retracted": F.lit(0.0)}))[0] >= 0.8


def test_metrics(spark):
    c = lambda s, m: one(spark, citations.metric_candidates(F.lit(s), m))[0]
    assert c("accuracy=0.81", "accuracy") == [0.81]
    assert c("step test loss: 9\nFinal test loss 3.5916e-02 +/- 1.8302e-03", "test loss") == [0.035916]
    assert c("accuracy=0.75\naccuracy=0.75", "accuracy") == [0.75, 0.75]


def test_chunks(spark):
    got = one(spark, citations.chunks(F.array(*[F.lit(x) for x in ("a" * 40, "b" * 40, "c" * 10, "d" * 60)]), 100, 20))[0]
    assert got == ["a" * 40 + "\n\n" + "b" * 40 + "\n\n" + "c" * 10, "c" * 10 + "\n\n" + "d" * 60]


def test_unicode(spark):
    assert one(spark, text.nfkd(F.lit("ﬁn é")))[0] == "fin é"
    assert one(spark, text.dehyphenated(F.lit("experi-\nment")))[0] == "experiment"
    assert one(spark, text.closed_brackets(F.lit("[1 0] [15 ] [ 18 ] [1-3]")))[0] == "[10] [15] [18] [1-3]"


def test_title_forms_are_decomposed(spark):
    from quillstone.functions import fuzzy
    from quillstone.functions import text as t

    rows = spark.createDataFrame([("Über <b>naïve</b> Größen", "Über naïve Größen"), ("ﬁne-tuning", "fine tuning"), (None, "")], "a string, b string")
    forms = [tuple(r) for r in rows.select(t.title_form(rows.a), t.title_form(rows.b)).collect()]
    assert forms == [("u ber nai ve gro ßen", "u ber nai ve gro ßen"), ("fine tuning", "fine tuning"), ("", "")]
    assert [r[0] for r in rows.select(fuzzy.title_similarity(rows.a, rows.b)).collect()] == [1.0, 1.0, 0.0]


def test_markers_with_kerning_pages_and_no_date(spark):
    from quillstone.functions import citations

    body = spark.createDataFrame([("as [1 0] and [1, p. 25] and (Meier n.d.) and (Lopez & Kim, 2019b, 392) say",)], "t string")
    n = body.select(citations.marker_counts(body.t).alias("n")).first().n
    assert n["NUMERIC_BRACKETED"] == 2 and n["AUTHOR_YEAR"] == 2


def test_facts_with_bare_versions_and_binary_units(spark):
    from quillstone.functions import environment

    readme = spark.createDataFrame([(1, "Needs Python 3 and CUDA 12.1\n500 GiB of disk")], "k long, t string")
    facts = {(r.category, r.value) for r in environment.documentation_facts(readme, "k", "t").collect()}
    assert {("python", "3"), ("cuda", "12.1"), ("storage", "500 GiB")} <= facts
    image = spark.createDataFrame([("FROM registry.example.org/python-3.10.2-slim\n",)], "t string")
    assert image.select(environment.container_facts(image.t).alias("f")).first().f.python_version == "3.10.2"


def test_domain_scores_without_a_product_of_rows_and_words(spark):
    from quillstone.operators import aggregates

    rows = spark.createDataFrame([(1, "Deep nets", "graph"), (2, None, "")], "k long, title string, body string")
    words = spark.createDataFrame([("ml", "deep"), ("ml", "net"), ("db", "graph")], "domain string, word string")
    out = aggregates.domain_scores(rows, "k", {"title": 5, "body": 2}, words)
    assert sorted(map(tuple, out.collect())) == [(1, "db", 2), (1, "ml", 10), (2, "db", 0), (2, "ml", 0)]
