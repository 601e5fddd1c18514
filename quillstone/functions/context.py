"""Texts cut to what a reader takes, and fields of references in running text (TVF10, TVF13, TVF15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where paragraphs and sentences end, and how an entry is numbered.
PARAGRAPH, SENTENCE = r"\n\s*\n", r"(?<=[.!?])\s+"
NUMBERED = r"^\s*\[(?:\d+|[A-Za-z][A-Za-z0-9+]*\d{2}[a-z]?)\]\s*"


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _packed(units: Column, limit: int | Column) -> Column:
    """Units joined by blanks as long as they fit; a longer one stays whole."""
    kind = "struct<held: string, done: array<string>>"

    def step(acc: Column, u: Column) -> Column:
        full = (acc["held"] != "") & (F.length(acc["held"]) + F.length(u) + 1 > limit)
        held = F.when(full, u).otherwise(F.trim(F.concat(acc["held"], F.lit(" "), u)))
        return F.struct(held.alias("held"), F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done")).cast(kind)

    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done")).cast(kind)
    return F.aggregate(units, start, step, lambda acc: F.concat(acc["done"], F.array(acc["held"])))


def _hard(text: Column, limit: int | Column) -> Column:
    """Stretches of at most ``limit`` code points that end before a blank where there is one."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    pattern = F.concat(F.lit(r"([\s\S]{1,"), n.cast("string"), F.lit(r"}\z|[\s\S]{1,"), (n - 1).cast("string"), F.lit(r"}(?= )|[\s\S]{1,"), n.cast("string"), F.lit("})"))
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.trim(x))


def large_text(text: Column, limit: int | Column) -> Column:
    """A text in pieces: itself where it is short, else its paragraphs, lines or sentences, the first that are
    several; longer ones in packed sentences, or at blanks where they are but one sentence. Null and '' are ''."""
    t = F.coalesce(text, F.lit(""))
    paragraphs, lines = _cut(t, PARAGRAPH), _cut(t, r"\r?\n")
    units = F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(lines) > 1, lines).otherwise(_cut(t, SENTENCE))

    def pieces(u: Column) -> Column:
        sentences = _cut(u, SENTENCE)
        return F.when(F.length(u) <= limit, F.array(u)).when(F.size(sentences) > 1, _packed(sentences, limit)).otherwise(_hard(u, limit))

    return F.when(F.length(t) <= limit, F.array(t)).otherwise(F.filter(F.flatten(F.transform(units, pieces)), lambda p: p != ""))


def _leading(units: Column, limit: Column, between: int) -> Column:
    """Units from the front as long as all of them fit."""
    kind = "struct<used: int, open: boolean, kept: array<string>>"

    def step(acc: Column, u: Column) -> Column:
        n = acc["used"] + F.length(u) + F.when(F.size(acc["kept"]) > 0, between).otherwise(0)
        ok = acc["open"] & (n <= limit)
        return F.struct(F.when(ok, n).otherwise(acc["used"]).alias("used"), ok.alias("open"), F.when(ok, F.concat(acc["kept"], F.array(u))).otherwise(acc["kept"]).alias("kept")).cast(kind)

    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept")).cast(kind)
    return F.aggregate(units, start, step, lambda acc: acc["kept"])


def semantic_prefix(text: Column, limit: int | Column) -> Column:
    """The front of a text in whole paragraphs, or in whole sentences where not even one paragraph fits."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    paragraphs = _leading(_cut(text, PARAGRAPH), limit, 2)
    sentences = _leading(_cut(text, SENTENCE), limit - 1, 1)
    return F.when(F.length(text) <= limit, text).when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n\n")).otherwise(F.array_join(sentences, " "))


def bounded_text(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` code points or so: a front of four fifths and paragraphs of its end for the rest.

    Of the last two fifths' paragraphs each that still fits is taken, from the end.
    """
    t, head = F.coalesce(text, F.lit("")), int(limit * 0.8)
    room = limit - head
    ends = F.reverse(_cut(F.substring(t, F.greatest(F.lit(1), F.length(t) - 2 * room + 1), F.length(t)), PARAGRAPH))
    kind = "struct<used: int, kept: array<string>>"

    def step(acc: Column, u: Column) -> Column:
        ok = acc["used"] + F.length(u) + 2 <= room
        return F.struct(F.when(ok, acc["used"] + F.length(u) + 2).otherwise(acc["used"]).alias("used"), F.when(ok, F.concat(F.array(u), acc["kept"])).otherwise(acc["kept"]).alias("kept")).cast(kind)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept")).cast(kind)
    tail = F.aggregate(ends, start, step, lambda acc: F.array_join(acc["kept"], ""))
    return F.when(F.length(t) <= limit, t).otherwise(F.regexp_replace(F.concat(semantic_prefix(t, head), F.lit("\n\n"), tail), r"^\s+|\s+$", ""))


def reference_fields(raw: Column) -> Column:
    """(title, authors) of an entry written ``[n] Authors. Title. Venue.`` or the same unnumbered.

    Initials end no sentence. An unnumbered entry needs several authors, and its title loses a year at its end and
    the hyphens of line breaks. Where there are no two sentences, or not those, title is null and authors empty.
    """
    numbered = raw.rlike(NUMBERED)
    flat = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))
    value = F.when(numbered, F.regexp_replace(F.regexp_replace(flat, r"\s+\.\s+", ". "), NUMBERED, "")).otherwise(flat)
    guarded = F.regexp_replace(value, r"\b([A-Z])\.\s+(?=[A-ZÀ-ÖØ-Þ])", "$1\u0001 ")
    parts = F.transform(F.split(guarded, r"\.\s+"), lambda p: F.regexp_replace(F.replace(p, F.lit("\u0001"), F.lit(".")), r"^[ .]+|[ .]+$", ""))
    by, title = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(title, r"^(.*?)(?:(?<=[?!])\s+.*)?$", 1), r"(?i),\s*(?:18|19|20)\d{2}[a-z]?$", ""), r"(?<=\w)-\s+(?=\w)", "")
    authors = F.filter(F.transform(F.split(by, r"\s*,\s*(?:and\s+)?|\s+and\s+"), lambda a: F.regexp_replace(a, r"^[ ,]+|[ ,]+$", "")), lambda a: a != "")
    ok = (by != "") & (title != "") & (numbered | by.contains(",") | by.contains(" and "))
    return F.struct(F.when(ok, F.nullif(F.when(numbered, title).otherwise(plain), F.lit(""))).alias("title"), F.when(ok, authors).otherwise(F.array().cast("array<string>")).alias("authors"))
