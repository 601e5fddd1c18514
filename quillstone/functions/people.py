"""Names of people: which parts of a reference read as authors, and which forms are one person (TVF06, WN09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of institutions that sign as authors.
INSTITUTIONS = (
    "association", "organization", "organisation", "committee", "institute", "society", "council", "academy", "commission",
    "department", "ministry", "who", "ieee", "acm", "iso", "world health", "united states",
)
#: Particles of surnames.
PARTICLES = ("d'", "de", "del", "van", "von", "da", "la")

_WORD = r"[\p{L}\p{N}_\-'̀-ͯ]"
#: A surname after initials or a given name, initials after a surname, a surname alone.
GIVEN_FIRST = rf"^[A-Z][.\-a-zA-Z̀-ͯ]*\s+((d'|de|del|van|von|da|la)\s+)?({_WORD}|\s)+$"
SURNAME_FIRST = rf"^{_WORD}+(\s+[A-Z]\.?)+$"
SURNAME = rf"^\p{{Lu}}{_WORD}*$"


def reads_as_author(segment: Column) -> Column:
    """Whether a part of a reference between commas is an author; null and blank parts are none."""
    s = F.regexp_replace(F.coalesce(segment, F.lit("")), r"^\s+|\s*[.,;]*\s*$", "")
    words = F.split(s, r"\s+")
    plain = F.filter(words, lambda w: w.rlike(r"\p{Ll}") & ~w.rlike(r"\p{Lu}") & ~w.isin(*PARTICLES))
    institution = F.lit(False)
    for name in INSTITUTIONS:
        institution = institution | F.lower(s).contains(name)
    person = (s.rlike(GIVEN_FIRST) & (F.size(words) <= 5) & (F.size(plain) <= 1)) | s.rlike(SURNAME_FIRST) | (s.rlike(SURNAME) & (F.length(s) < 25))
    return F.length(s).between(1, 60) & (s.rlike(r"(?i)\bet al\b") | institution | person)


def name_tokens(name: Column) -> Column:
    """Lower-case words of letters and digits of a name."""
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def same_person(a: Column, b: Column) -> Column:
    """Whether two names' tokens are equal, or agree at both ends with one a part of the other."""
    ends = (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))) & (F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)))
    contained = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (a == b) | ((F.size(a) >= 2) & (F.size(b) >= 2) & F.coalesce(ends & contained, F.lit(False)))


def distinct_people(names: Column) -> Column:
    """The names of a paper in order, without those that an earlier one already stands for; blank names are left out."""
    start = F.array().cast("array<struct<name:string,tokens:array<string>>>")

    def step(kept: Column, name: Column) -> Column:
        tokens = name_tokens(name)
        known = F.exists(kept, lambda k: same_person(tokens, k["tokens"]))
        return F.when(known | (F.coalesce(name, F.lit("")) == ""), kept).otherwise(F.array_append(kept, F.struct(name.alias("name"), tokens.alias("tokens"))))

    return F.transform(F.aggregate(names, start, step), lambda k: k["name"])
