"""Text normal forms (SC01-SC16). What Spark has no function for, Unicode normalisation, is an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def decomposed(text: Column) -> Column:
    """NFKD of a text. ASCII, which it leaves alone, is not worked on: Python gets null in its place."""
    return F.coalesce(nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def title_form(text: Column) -> Column:
    """Decomposed, lower case, no tags, squeezed, with blanks for all but letters, numbers, _ and white space: marks too."""
    t = F.regexp_replace(F.lower(F.coalesce(decomposed(text), F.lit(""))), "<[^>]+>", " ")
    return squeeze(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", " "))


def alnum_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def no_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z]{2,})-[ \t]*\n\s*([A-Za-z]{2,})", "$1$2")


def closed_brackets(text: Column) -> Column:
    """``[1 0]`` as ``[10]``, ``[ 18 ]`` as ``[18]``; ranges and lists stay."""
    t = F.regexp_replace(text, r"\[\s*([0-9]+)\s*\]", "[$1]")
    for _ in range(3):
        t = F.regexp_replace(t, r"\[\s*([0-9]+)\s+([0-9]+(?:\s+[0-9]+)*)\s*\]", "[$1$2]")
    return t


def terms(text: Column, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Distinct lower-case alphanumeric words of a least length, none of them a stop word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    words = F.filter(words, lambda w: F.length(w) >= least)
    return F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else words


def redacted(text: Column) -> Column:
    """Assignments to secret names with the value replaced."""
    return F.regexp_replace(text, r"(?i)\b([A-Z0-9_]*(?:token|secret|password|api_?key)[A-Z0-9_]*)\s*[=:]\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"']+)", "$1=[REDACTED]")


def secret_name(name: Column) -> Column:
    return F.upper(name).rlike("KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|AUTH")


def author_parts(author: Column) -> Column:
    """(surname, initials) of one author in any of the usual orders; both lower case."""
    a = F.trim(F.regexp_replace(squeeze(author), r"\([^)]*\)", ""))
    family = F.lower(F.regexp_replace(F.substring_index(a, ",", 1), r"(?U)\W", ""))
    given = F.regexp_extract_all(F.substring(a, F.length(F.substring_index(a, ",", 1)) + 2, F.length(a)), F.lit(r"(?U)\b(\w)"), F.lit(1))
    behind, before = r"(?U)^([\w-]+)\s+([A-Z.\s]+)$", r"(?U)^([A-Z.\s]+)\s+([\w-]+)$"
    letters = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z]", ""))
    words = F.split(a, " ")
    both = lambda s, i: F.struct(s.alias("surname"), i.alias("initials"))
    return (
        F.when(a == "", both(F.lit(""), F.lit("")))
        .when(a.contains(","), both(family, F.lower(F.array_join(given, ""))))
        .when(a.rlike(behind), both(F.lower(F.regexp_extract(a, behind, 1)), letters(F.regexp_extract(a, behind, 2))))
        .when(a.rlike(before), both(F.lower(F.regexp_extract(a, before, 2)), letters(F.regexp_extract(a, before, 1))))
        .when(F.size(words) == 1, both(F.lower(a), F.lit("")))
        .otherwise(both(F.lower(F.element_at(words, -1)), F.lower(F.substring(a, 1, 1))))
    )


def author_list(authors: Column) -> Column:
    """Array of (surname, initials), cut at semicolons, else at 'and' and '&', else at commas."""
    a = F.trim(F.coalesce(authors, F.lit("")))
    cut = F.when(a.contains(";"), F.split(a, ";")).when(a.rlike(r"(?i)\band\b|&"), F.split(a, r"(?i)\band\b|&")).otherwise(F.split(a, ","))
    names = F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(names, author_parts), lambda x: x["surname"] != "")


def heading_form(text: Column) -> Column:
    """A heading without numbering and outer punctuation, lower case."""
    t = F.regexp_replace(F.lower(squeeze(text)), r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+|[a-z])[.)]?\s+", "")
    return F.trim(F.regexp_replace(t, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))


def location(doc: str, line: str, heading: Column) -> Column:
    """The nearest heading at or before each line of a document (use in a select)."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(heading, ignorenulls=True).over(w)


def stable_id(prefix: str, *parts: Column, missing: str = "none") -> Column:
    """``PREFIX-`` and 16 hash digits of the parts; absent and empty parts count alike."""
    joined = F.concat_ws(":", *[F.coalesce(F.nullif(p.cast("string"), F.lit("")), F.lit(missing)) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(joined, 256), 1, 16)))


def located(text: Column, pattern: str, *groups: int) -> Column:
    """Matches of a pattern in a text: an array of (whole, g1, g2, ..., start, end), the groups asked for and code points.

    Offsets are summed up from the lengths of the matches and of what stands between them, within the row.
    """
    wholes, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern), F.length)
    parts = [wholes.alias("whole"), gaps.alias("gap"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]]
    each = F.filter(F.arrays_zip(*parts), lambda x: x["whole"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    reached = lambda a, x: a["at"] + x["gap"] + F.length(x["whole"])
    ends = lambda of: F.aggregate(of, zero, lambda a, x: F.struct(reached(a, x).alias("at"), F.concat(a["ends"], F.array(reached(a, x))).alias("ends")), lambda a: a["ends"])
    placed = lambda x, end: F.struct(x["whole"].alias("whole"), *[x[f"g{g}"].alias(f"g{g}") for g in groups], (end - F.length(x["whole"])).alias("start"), end.alias("end"))
    return bound(each, lambda of: F.zip_with(of, ends(of), placed))


def around(text: Column, start: Column, end: Column, window: int) -> Column:
    """The text around a stretch of it, white space squeezed."""
    left = F.greatest(F.lit(0), start - window)
    return F.regexp_replace(F.regexp_replace(F.substr(text, (left + 1).cast("int"), (end + window - left).cast("int")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def bound(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stretches(of: Column, ends: Column) -> Column:
    """An array cut after each of some places, in order; what follows the last one is one more stretch."""

    def parts(e: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(e, lambda i: i + 1))
        return F.filter(F.zip_with(starts, F.concat(e, F.array(F.size(of))), lambda a, z: F.slice(of, a, F.greatest(z - a + 1, F.lit(0)))), lambda x: F.size(x) > 0)

    return bound(ends, parts)
