"""Fuzzy similarity of titles, authors, journals and whole records (SC40-SC49).

The ratio is 200 * LCS / (len a + len b). It has no Spark function and runs in Arrow batches over distinct
pairs; everything around it is Column expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import author_list, bound, title_form

#: Words that carry no meaning in a title.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "are", "was", "were",
    "using", "based", "via", "towards", "study", "analysis",
)
#: Weights of the record score, renormalised over what both sides have.
WEIGHTS = {"title": 0.40, "author": 0.25, "journal": 0.15, "year": 0.10, "pages": 0.10}


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step for each character of ``b``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (len(both) == len(x) or len(both) == len(y)):
        return 100.0
    i, left, right = " ".join(both), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    l, r = (f"{i} {left}".strip(), f"{i} {right}".strip())
    return max(ratio(l, r), ratio(i, l) if i else 0.0, ratio(i, r) if i else 0.0)


def _pairs(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = f(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run


token_sort_ratio = _pairs(token_sort)
token_set_ratio = _pairs(token_set)


def content_words(form: Column) -> Column:
    """Distinct words of a title form without stop words; all of them where nothing else is left."""
    words = F.array_distinct(F.filter(F.split(form, " "), lambda w: w != ""))
    kept = F.array_except(words, F.array(*[F.lit(s) for s in STOP_WORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def _likeness(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Similarity of two title forms with their content words; the letters of equal forms are not compared."""
    differ, words = (x != "") & (y != "") & (x != y), lambda c: F.array_join(F.array_sort(c), " ")
    shared = F.size(F.array_intersect(cx, cy)) > 0
    sort = token_sort_ratio(F.when(differ, words(cx)), F.when(differ, words(cy))) / 100
    whole = token_set_ratio(F.when(differ, x), F.when(differ, y)) / 100
    share = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    contained = (F.length(x) > 15) & (F.length(y) > 15) & (x.contains(y) | y.contains(x)) & (share > 0.6)
    blend = F.when(shared, 0.35 * jaccard(cx, cy) + 0.35 * sort + 0.30 * whole).otherwise(0.40 * sort)
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(contained, F.greatest(F.lit(0.9), F.round(share, 4))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(blend, 4))))


def title_similarity(a: Column, b: Column) -> Column:
    """Similarity of two titles from 0 to 1."""
    x, y = title_form(a), title_form(b)
    return _likeness(x, y, content_words(x), content_words(y))


def with_title_similarity(df: DataFrame, a: Column, b: Column, score: str, least: float | None = None) -> DataFrame:
    """``df`` with the similarity of two titles as the column ``score``, only the rows of at least ``least`` if that is given.

    The titles' forms are worked out once for each row. Letters count for at most 0.65: where the words in common leave
    ``least`` out of reach, and neither holds the other, letters are not compared.
    """
    # Arrays of one, exploded: what is in them is worked out once for each row, however often it is used.
    rows = df.withColumns({"__x": title_form(a), "__y": title_form(b)})
    rows = rows.withColumn("__w", F.explode(F.array(F.struct("__x", "__y")))).drop("__x", "__y")
    x, y = F.col("__w.__x"), F.col("__w.__y")
    rows = rows.withColumn("__c", F.explode(F.array(F.struct(content_words(x).alias("x"), content_words(y).alias("y")))))
    cx, cy = F.col("__c.x"), F.col("__c.y")
    if least is not None:
        # A thousandth of room for what rounding adds.
        rows = rows.filter(x.contains(y) | y.contains(x) | (0.35 * jaccard(cx, cy) + 0.65 >= least - 1e-3))
    rows = rows.withColumn(score, _likeness(x, y, cx, cy)).drop("__w", "__c")
    return rows if least is None else rows.filter(F.col(score) >= least)


def author_similarity(a: Column, b: Column) -> Column:
    """Half the first author's match, half the surnames' overlap; a fuzzy ratio where no list can be read."""
    initial = lambda p: F.substring(p["initials"], 1, 1)

    def listed(x: Column, y: Column) -> Column:
        sx, sy = F.transform(x, lambda p: p["surname"]), F.transform(y, lambda p: p["surname"])
        fx, fy = F.get(x, F.lit(0)), F.get(y, F.lit(0))
        first = (
            F.when(fx["surname"] == fy["surname"], F.when((initial(fx) != "") & (initial(fx) == initial(fy)), 1.0).otherwise(0.9))
            .when(F.array_contains(sy, fx["surname"]) | F.array_contains(sx, fy["surname"]), 0.6)
            .otherwise(0.0)
        )
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.round(0.5 * first + 0.5 * jaccard(F.array_distinct(sx), F.array_distinct(sy)), 4))

    # Each list is read once, however often it is used.
    known = bound(author_list(a), lambda x: bound(author_list(b), lambda y: listed(x, y)))
    said = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    loose = F.round(token_set_ratio(F.lower(a), F.lower(b)) / 100, 4)
    return F.coalesce(known, F.when(said, loose), F.lit(0.0))


def first_page(pages: Column) -> Column:
    return F.trim(F.get(F.split(pages, "[-‐‑‒–—―]"), F.lit(0)))


def year_score(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.7).when(a.isNotNull() & b.isNotNull(), 0.0)


def composite(title: Column, author: Column, journal: Column, year: Column, pages: Column) -> Column:
    """Weighted mean of the scores that are not null."""
    scores = {"title": title, "author": author, "journal": journal, "year": year, "pages": pages}
    total = sum(F.when(s.isNotNull(), WEIGHTS[k] * s).otherwise(0.0) for k, s in scores.items())
    weight = sum(F.when(s.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, s in scores.items())
    return F.round(F.when(weight > 0, total / weight).otherwise(0.0), 4)


#: Weights of the correctness probability, in the order of its features.
LOGISTIC = {
    "title_similarity": 3.50, "author_similarity": 2.20, "journal_similarity": 1.20, "year_match": 1.00, "volume_match": 0.60, "pages_match": 0.60,
    "composite_score": 2.00, "doi_resolves": 1.50, "is_redirect": 0.10, "is_restricted": -0.50, "is_retracted": -3.00,
}
BIAS = -4.50


def probability(features: dict[str, Column]) -> Column:
    """Logistic probability that a reference is correct, 4 digits."""
    z = F.lit(BIAS)
    for k, w in LOGISTIC.items():
        z = z + w * features[k].cast("double")
    z = F.least(F.lit(20.0), F.greatest(F.lit(-20.0), z))
    return F.round(1 / (1 + F.exp(-z)), 4)


def predicted_label(p: Column, title: Column, resolves: Column, http_status: Column) -> Column:
    return (
        F.when(~resolves & (http_status == 404), "INVALID")
        .when(resolves & (title < 0.35), "WRONG_REFERENCE")
        .when(p >= 0.75, "CORRECT")
        .when(p >= 0.45, "AMBIGUOUS")
        .otherwise("INCORRECT")
    )


def coverage(needed: Column, there: Column) -> Column:
    return F.when(F.size(needed) > 0, F.size(F.array_intersect(needed, there)) / F.size(needed)).otherwise(F.lit(0.0))
