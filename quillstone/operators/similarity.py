"""Similar texts within a paper or document: claims and citation contexts, titles moved from their place (JN03, JN07).

The token-set ratio counts letters, so that no word has to be shared for a good score, and no index of words finds all
pairs. Claims are therefore a stated query set that meets a paper's contexts in blocks: a task gets at most
``BLOCK`` of either, bounds all pairs' scores at once by the letters and words that they share, and works out and
returns only those that can reach the limit. A paper of any size is so many blocks. Titles have to share a word
to be similar, and only those that their place does not settle are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fuzzy
from quillstone.functions.fuzzy import token_set
from quillstone.functions.text import title_form

#: Claims and contexts that one task compares, at most, and pairs whose letters are counted at a time.
BLOCK, PAIRS = 512, 20_000
#: What a claim and a context have in common at least, and contexts kept for each claim.
LEAST, TOP = 55.0, 3
#: A place is given up below the first, another is taken from the second on, titles are longer than the third.
LOST, SURE, SHORT = 0.35, 0.70, 10
#: Ground-truth rows of a document up to which an open title is compared with all of them.
FEW = 64


def score_block(a: list[str], b: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, score) of all pairs of two lists whose token-set ratio is at least ``least``."""
    left, right = [sorted(set(t.split())) for t in a], [sorted(set(t.split())) for t in b]
    words: dict[str, int] = {}
    letters: dict[str, int] = {}
    for tokens in (*left, *right):
        for t in tokens:
            words.setdefault(t, len(words))
            for c in t:
                letters.setdefault(c, len(letters))
    letters.setdefault(" ", len(letters))

    def counted(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has, bag = np.zeros((len(texts), len(words)), np.float32), np.zeros((len(texts), len(letters)), np.int32)
        for i, tokens in enumerate(texts):
            has[i, [words[t] for t in tokens]] = 1
            np.add.at(bag[i], [letters[c] for c in " ".join(tokens)], 1)
        return has, bag, bag.sum(axis=1)

    (ha, ba, na), (hb, bb, nb) = counted(left), counted(right)
    size = np.array([len(w) for w in words], np.float32)
    shared, chars = ha @ hb.T, (ha * size) @ hb.T
    common = np.where(shared > 0, chars + shared - 1, 0)  # length of the words in common, joined by blanks
    total = (na[:, None] > 0) & (nb[None, :] > 0)
    whole = (shared > 0) & ((shared == ha.sum(axis=1)[:, None]) | (shared == hb.sum(axis=1)[None, :]))
    # Words in common are the front of both sides: these two of the three ratios are known without comparing letters.
    known = np.where(shared > 0, np.maximum(200 * common / np.maximum(1, common + na[:, None]), 200 * common / np.maximum(1, common + nb[None, :])), 0.0)
    for start in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
        stop = start + max(1, PAIRS // max(1, len(right)))
        bound = 200 * np.minimum(ba[start:stop, None, :], bb[None, :, :]).sum(axis=2) / np.maximum(1, na[start:stop, None] + nb[None, :])
        # A thousandth of a point of room for what floats leave out; scores are worked out anew.
        for i, j in zip(*np.nonzero(total[start:stop] & (whole[start:stop] | (np.maximum(bound, known[start:stop]) >= least - 1e-3))), strict=True):
            score = 100.0 if whole[start + i, j] else token_set(a[start + i], b[j])
            if score >= least:
                yield int(start + i), int(j), float(score)


def _blocks(df: DataFrame, paper: str) -> DataFrame:
    """The rows with a block of their paper, each of about ``BLOCK`` rows or fewer, and the number of these."""
    sizes = df.groupBy(paper).agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("__blocks"))
    return df.join(sizes, paper).withColumn("__block", F.pmod(F.xxhash64("__id"), F.col("__blocks")))


def similar_texts(claims: DataFrame, contexts: DataFrame, paper: str, claim: str, context: str, least: float = LEAST) -> DataFrame:
    """(paper, claim, context, similarity): the pairs of distinct texts of one paper with a token-set ratio of at least ``least``.

    ``claims`` and ``contexts`` have the column ``paper`` and a text each; null and blank texts are in no pair.
    """
    said = lambda df, c: df.filter(F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")).select(F.col(paper).alias("__p"), F.col(c).alias("__id")).distinct()
    a, b = _blocks(said(claims, claim), "__p"), _blocks(said(contexts, context), "__p")
    counts = lambda df: df.select("__p", F.col("__blocks").alias("__others")).distinct()
    many = lambda df, others: df.join(counts(others), "__p").withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__others") - 1)))
    x = many(a, b).select("__p", F.col("__block").alias("__i"), F.col("__other").alias("__j"), "__id")
    y = many(b, a).select("__p", F.col("__other").alias("__i"), F.col("__block").alias("__j"), "__id")
    kind = dict(a.dtypes)["__p"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = left.column("__id").to_pylist(), right.column("__id").to_pylist()
        found = list(score_block(one, two, least)) if one and two else []
        p = left.column("__p").take(pa.array([i for i, _, _ in found], pa.int64()))
        return pa.table({"__p": p, "__a": pa.array([one[i] for i, _, _ in found], pa.string()), "__b": pa.array([two[j] for _, j, _ in found], pa.string()), "similarity": pa.array([s for _, _, s in found], pa.float64())})

    pairs = x.groupBy("__p", "__i", "__j").cogroup(y.groupBy("__p", "__i", "__j")).applyInArrow(compare, f"__p {kind}, __a string, __b string, similarity double")
    return pairs.select(F.col("__p").alias(paper), F.col("__a").alias(claim), F.col("__b").alias(context), "similarity")


def cited_references(citations: DataFrame, references: DataFrame, paper: str) -> DataFrame:
    """Each citation with the references that it means: those of its numbers, else those of its authors and years.

    ``citations`` has paper, citation_id, keys (numbers), marker, content, author and year; ``references`` has paper,
    reference_id, number, authors (an array) and year. Authors are compared by their last words.
    """
    numbered = citations.select(paper, "citation_id", F.explode(F.array_distinct("keys")).alias("number")).join(references.select(paper, "number", "reference_id"), [paper, "number"]).select(paper, "citation_id", "reference_id")
    text = F.concat_ws(" ", "author", "year", "content", "marker")
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:18|19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][A-Za-zÀ-ɏ\-']+)\b"), F.lit(1)), F.lower), lambda n: ~n.isin("et", "al"))
    rest = citations.join(numbered.select(paper, "citation_id").distinct(), [paper, "citation_id"], "left_anti")
    wanted = rest.select(paper, "citation_id", F.explode(F.array_distinct(names)).alias("surname"), years.alias("years")).select(paper, "citation_id", "surname", F.explode(F.array_distinct("years")).alias("year"))
    surname = lambda a: F.lower(F.element_at(F.split(F.trim(F.regexp_replace(a, r"(?U)[^\w\-']+", " ")), " "), -1))
    listed = references.select(paper, "reference_id", "year", F.explode(F.array_distinct(F.transform(F.coalesce("authors", F.array().cast("array<string>")), surname))).alias("surname")).filter("year is not null and surname <> ''")
    dated = wanted.join(listed, [paper, "surname", "year"]).select(paper, "citation_id", "reference_id").distinct()
    return numbered.unionByName(dated)


def map_claims(claims: DataFrame, citations: DataFrame, references: DataFrame, paper: str, least: float = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` references of each claim, by the citations whose contexts it resembles.

    ``claims`` has paper, claim_id and claim_text, ``citations`` besides the columns of ``cited_references`` place (their
    order) and context. Returns paper, claim_id, rank, reference_id, marker, context, similarity (0 to 1): of several
    citations with one context and reference the most similar, then the first. Nothing is upgraded to support by this.
    """
    pairs = similar_texts(claims, citations, paper, "claim_text", "context", least)
    meant = cited_references(citations, references, paper)
    rows = claims.select(paper, "claim_id", "claim_text").join(pairs, [paper, "claim_text"]).join(citations.select(paper, "citation_id", "place", "marker", "context"), [paper, "context"]).join(meant, [paper, "citation_id"])
    order = references.select(paper, "reference_id", F.col("number").alias("__n"))
    rows = rows.join(order, [paper, "reference_id"])
    key = [paper, "claim_id", "reference_id", "context"]
    first = rows.groupBy(*key).agg(F.max("similarity").alias("similarity"), F.min(F.struct("place", "__n", "marker")).alias("f"))
    w = Window.partitionBy(paper, "claim_id").orderBy(F.desc("similarity"), "f.place", "f.__n", "reference_id")
    ranked = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select(paper, "claim_id", "rank", "reference_id", "f.marker", "context", (F.col("similarity") / 100).alias("similarity"))


def repaired_places(references: DataFrame, ground: DataFrame, doc: str) -> DataFrame:
    """The ground-truth row of each reference: that at its place, unless another one's title is clearly meant.

    Both tables have ``doc``, reference_no and title. A row at the place whose title is unlike (under 0.35) gives way to
    the most similar of at least 0.70, where the document has several; without a row at the place the first of at
    least 0.70 is taken. Titles of ten characters or fewer stay. Returns doc, reference_no, ground_no and whether it was
    repaired. Numbers should be unique in a document. Only titles that share a word can be that similar, or one holds
    the other: these are compared, for the references that their place does not settle. In a document of at most
    ``FEW`` rows the open titles meet them all, so that no title is taken apart.
    """
    g = ground.select(F.col(doc).alias("d"), F.col("reference_no").alias("ground_no"), F.col("title").alias("g_title"))
    counts = g.groupBy("d").agg(F.count("*").alias("n"))
    r = references.select(F.col(doc).alias("d"), "reference_no", "title").join(g.withColumn("reference_no", F.col("ground_no")), ["d", "reference_no"], "left").join(counts, "d", "left")
    long, said = F.length(F.coalesce("title", F.lit(""))) > SHORT, F.coalesce("g_title", F.lit("")) != ""
    asked = F.when(long & F.col("ground_no").isNotNull() & said & (F.col("n") > 1), F.col("title"))
    r = fuzzy.with_title_similarity(r, asked, F.when(asked.isNotNull(), F.col("g_title")), "here")
    lost = long & (F.col("ground_no").isNull() | (asked.isNotNull() & (F.col("here") < LOST)))
    few = F.coalesce("n", F.lit(0)) <= FEW
    open_ = r.filter(lost).select("d", "reference_no", "title", F.col("ground_no").isNotNull().alias("placed"), few.alias("few"))
    said = g.filter(F.coalesce("g_title", F.lit("")) != "")
    # Of a document with few rows all are compared; words and letters find the pairs of the others.
    near = open_.filter("few").drop("few").join(said, "d")
    far = open_.filter("not few").drop("few")
    a = far.withColumn("form", title_form(F.col("title"))).select("d", "reference_no", "title", "placed", F.explode(_title_keys(F.col("form"))).alias("k"))
    b = said.join(counts.filter(F.col("n") > FEW).select("d"), "d", "left_semi").withColumn("form", title_form(F.col("g_title"))).select("d", "ground_no", "g_title", F.explode(_title_keys(F.col("form"))).alias("k"))
    pairs = a.join(b, ["d", "k"]).select("d", "reference_no", "title", "placed", "ground_no", "g_title").distinct().unionByName(near)
    scored = fuzzy.with_title_similarity(pairs, F.col("title"), F.col("g_title"), "s", SURE)
    best = scored.groupBy("d", "reference_no").agg(F.min_by("ground_no", F.when(F.col("placed"), F.struct((-F.col("s")).alias("s"), F.col("ground_no").alias("n"))).otherwise(F.struct(F.lit(0.0).alias("s"), F.col("ground_no").alias("n")))).alias("better"))
    out = r.join(best, ["d", "reference_no"], "left")
    return out.select(F.col("d").alias(doc), "reference_no", F.coalesce("better", "ground_no").alias("ground_no"), F.col("better").isNotNull().alias("repaired"))


def _title_keys(form: Column) -> Column:
    """What two titles share if they can be similar: a content word, or, where one holds the other, 16 letters in a row.

    Where a title is held by another with at most ten parts for its six, both have its first 16 letters, at some place.
    """
    words = fuzzy.content_words(form)
    places = F.when(F.length(form) > 15, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(form) - 15))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda p: F.concat(F.lit("\u0001"), F.substring(form, p, F.lit(16))))
    return F.array_distinct(F.concat(F.filter(words, lambda w: w != ""), grams))
