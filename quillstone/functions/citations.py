"""References and citations in text, as Column expressions over one row (PRJ03, TVF01-TVF09, AG24).

Order-dependent folds are ``aggregate`` over an array of the row's own tokens, so nothing is shuffled and
no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.identifiers import doi_extract, first_url
from quillstone.functions.text import bound, stretches

#: How years, authors, pages and markers look.
YEAR_AT_END = r"(?i)\(\s*(?:18|19|20)\d{2}[a-z]?\s*\)\s*$"
YEAR_ANYWHERE = r"(?i)\(\s*((?:18|19|20)\d{2})[a-z]?\s*\)"
YEAR_BARE = r"\b((?:18|19|20)\d{2})\b"
AUTHOR_START = r"^[A-Z][a-zA-Z\-']{1,25}\s+(?:[A-Z]\.?){1,3}(?:;|,|\.|\s)"
AUTHOR_DATE = r"[A-ZÀ-ɏ][A-Za-zÀ-ɏ'-]+,\s+(?:[A-Z]\.[ -]?){1,4}[^()\n]{0,200}\((?:18|19|20)\d{2}[a-z]?\)"
LINK_AT_END = r"(?i)(?:https?://\S+|doi:\s*\S+|10\.\d{4,9}/\S+)\s*$"
JOURNAL_CUE = r"(?i)\b(?:pp\.|pages|vol\.|volume|no\.)"
PAGES = r"(?i)\bpp?\.?\s*([A-Za-z]?\d+(?:\s*[-–—]\s*[A-Za-z]?\d+)?)"
MARKERS = {
    "NUMERIC_BRACKETED": r"\[\s*(\d+(?:\s+\d+)*(?:\s*[-–—,;]\s*\d+(?:\s+\d+)*)*)\s*(?:,\s*p{1,2}\.?\s*\d+)?\s*\]",
    "AUTHOR_YEAR": r"\(([A-Z][A-Za-zÀ-ɏ'-]+(?:\s+(?:&|and)\s+[A-Z][A-Za-zÀ-ɏ'-]+|\s+et\s+al\.)?,?\s*(?:(?:18|19|20)\d{2}[a-z]?|n\.d\.[a-z]?)(?:,\s*(?:p{1,2}\.?\s*)?\d{1,4})?(?:;[^)]+)?)\)",
    "NUMERIC_SUPERSCRIPT": r"([⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:[-–—,][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*)",
    "NUMERIC_PARENTHETICAL": r"(?<![A-Za-z0-9_])\(\s*(\d+(?:\s*[-–—,;]\s*\d+)*)\s*\)(?![A-Za-z0-9_])",
    "FOOTNOTE_NOTE": r"(?i)\[(?:Footnote|Note)\]\s*(\d{0,4})",
}


def reference_year(raw: Column) -> Column:
    """The last year in brackets, else the last bare one, from 1800 to 2030."""
    marked, bare = F.regexp_extract_all(raw, F.lit(YEAR_ANYWHERE), F.lit(1)), F.regexp_extract_all(raw, F.lit(YEAR_BARE), F.lit(1))
    year = F.coalesce(F.try_element_at(marked, F.lit(-1)), F.try_element_at(bare, F.lit(-1))).try_cast("int")
    return F.when(year.between(1800, 2030), year)


def reference_record(raw: Column, extra: Column | None = None) -> Column:
    """Year, identifiers and review reasons of one reference string."""
    year, markers = reference_year(raw), F.regexp_count(raw, F.lit(YEAR_ANYWHERE))
    reasons = F.array_compact(F.array(
        F.when(year.isNull(), "NO_YEAR_DETECTED"), F.when(markers > 1, "MULTIPLE_YEAR_MARKERS"),
        F.when(F.length(raw) > 600, "SUSPICIOUSLY_LONG_REFERENCE").when(F.length(raw) < 25, "SUSPICIOUSLY_SHORT_REFERENCE"),
    ))
    if extra is not None:
        reasons = F.array_distinct(F.concat(extra, reasons))
    doi, url = F.coalesce(doi_extract(raw), F.lit("")), F.coalesce(first_url(raw), F.lit(""))
    return F.struct(year.alias("cited_year"), markers.cast("int").alias("year_marker_count"), doi.alias("extracted_doi"), url.alias("extracted_url"), reasons.alias("review_reasons"), (F.size(reasons) > 0).alias("needs_review"))


def split_references(text: Column) -> Column:
    """Array of (raw, reasons): a composite text cut at the semicolons that end a reference.

    A token ends one if a year in brackets closes it; if it has such a year or ends with a link, and an author
    starts the next; or if three tokens or more with a journal's cues are gathered and an author starts the
    next. What is left at the end is a remainder. Tokens that end one by themselves cut the text into stretches,
    and only within a stretch is what is gathered followed from token to token: a text of any length is many of them.
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    tokens = F.filter(F.transform(F.split(squeezed, ";"), lambda t: F.trim(t)), lambda t: t != "")

    def judged(t: Column, n: Column) -> Column:
        author = F.coalesce(n, F.lit("")).rlike(AUTHOR_START)
        closed = t.rlike(YEAR_AT_END) | (author & (t.rlike(YEAR_ANYWHERE) | t.rlike(LINK_AT_END)))
        return F.struct(t.alias("t"), closed.alias("closed"), author.alias("author"), t.rlike(JOURNAL_CUE).alias("cue"))

    with_next = lambda of: F.zip_with(of, F.concat(F.slice(of, F.lit(2), F.greatest(F.size(of) - 1, F.lit(0))), F.array(F.lit(""))), judged)
    cut = lambda of: F.flatten(F.transform(stretches(of, F.filter(F.sequence(F.lit(1), F.size(of)), lambda i: F.element_at(of, i)["closed"])), _pieces))
    nothing = F.array().cast("array<struct<raw: string, reasons: array<string>>>")
    return bound(tokens, lambda of: F.when(F.size(of) > 0, bound(with_next(of), cut)).otherwise(nothing))


def _pieces(stretch: Column) -> Column:
    """The references of a stretch of tokens, of which the last alone may end one by itself."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.lit(False).alias("cue"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        cue = acc["cue"] | x["cue"]
        late = ~x["closed"] & x["author"] & (acc["held"] >= 2) & cue
        return F.struct((acc["at"] + 1).alias("at"), F.when(late, 0).otherwise(acc["held"] + 1).alias("held"), (cue & ~late).alias("cue"), F.when(late, F.concat(acc["cuts"], F.array(acc["at"] + 1))).otherwise(acc["cuts"]).alias("cuts"))

    def piece(x: Column) -> Column:
        last = F.element_at(x, -1)
        none, no_year, rest = F.array().cast("array<string>"), F.array(F.lit("SPLIT_ON_AUTHOR_BOUNDARY_WITHOUT_YEAR")), F.array(F.lit("TRAILING_REMAINDER_NO_CLOSING_YEAR"), F.lit("TRAILING_REMAINDER"))
        # A piece that ends without a year is cut where an author follows; else nothing follows, and it is the remainder.
        reasons = F.when(last["closed"], none).when(last["author"], no_year).otherwise(rest)
        return F.struct(F.array_join(F.transform(x, lambda t: t["t"]), "; ").alias("raw"), reasons.alias("reasons"))

    cuts = F.aggregate(stretch, zero, step, lambda acc: acc["cuts"])
    return bound(cuts, lambda c: F.transform(stretches(stretch, c), piece))


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each reference of each document: reference_id ``key_0001``, number, raw text, record."""
    each = df.select(key, F.posexplode(split_references(F.col(text))).alias("pos", "r"))
    number = F.col("pos") + 1
    ident = F.format_string("%s_%04d", F.col(key).cast("string"), number)
    return each.select(key, ident.alias("reference_id"), number.alias("reference_no"), F.col("r.raw").alias("raw_reference"), reference_record(F.col("r.raw"), F.col("r.reasons")).alias("record")).select(key, "reference_id", "reference_no", "raw_reference", "record.*")


def split_bibliography(text: Column) -> Column:
    """Parts of a manuscript's bibliography: numbered by ``[n]``, ``n.`` or ``(n)``, else paragraphs, else lines."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "))

    def parts(pattern: str, least: int) -> Column:
        return F.filter(F.transform(F.split(t, pattern), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > least)

    tries = [
        (F.regexp_count(t, F.lit(r"(?m)^\s*\[\d+\]\s+")) >= 2, parts(r"(?m)(?=^\s*\[\d+\]\s+)", 15)),
        (F.regexp_count(t, F.lit(r"(?:^|[\s.>)\]\"”’])\[\d{1,3}\]\s*(?=[A-ZÀ-ɏ\"“])")) >= 2, parts(r"(?=(?:^|(?<=[\s.>)\]\"”’]))\[\d{1,3}\]\s*[A-ZÀ-ɏ\"“])", 15)),
        (F.slice(F.regexp_extract_all(t, F.lit(r"(?m)^\s*(\d+)\.\s+"), F.lit(1)), 1, 2) == F.array(F.lit("1"), F.lit("2")), parts(r"(?m)(?=^\s*\d+\.\s+)", 15)),
        (F.regexp_count(t, F.lit(r"(?m)^\s*\(\d+\)\s+")) >= 2, parts(r"(?m)(?=^\s*\(\d+\)\s+)", 15)),
        (F.regexp_count(t, F.lit(AUTHOR_DATE)) >= 2, parts(rf"(?<=[a-z0-9)]\.)\s+(?={AUTHOR_DATE})", 20)),
        (t.rlike(r"\n\s*\n"), parts(r"\n\s*\n+", 20)),
        (t.contains(";"), parts(";", 15)),
        (t.contains("\n"), parts("\n", 25)),
    ]
    out = None
    for condition, found in tries:
        ok = condition & (F.size(found) >= 2)
        out = F.when(ok, found) if out is None else out.when(ok, found)
    return out.otherwise(F.array(F.trim(F.regexp_replace(t, r"\s+", " "))))


#: Where a reference starts that was merged into the one before, by its bracketed or dotted number.
MERGED = (
    r"(?:^|(?<=[\s.>)\]\"”’]))(?=\[\d{1,3}\]\s*[A-ZÀ-ɏ\"“])",
    r"(?:^|(?<=[\s.>)\]\"”’]))(?=\d{1,3}\.\s+[A-ZÀ-ɏ\"“])",
)


def unmerged(part: Column) -> Column:
    """The references in one part of a bibliography: cut before every number where it holds two or more.

    Bracketed numbers go before dotted ones; pieces of 15 characters or fewer are no references. Digits that were
    drawn apart within brackets are joined first. A part without merged references stays whole, null gives none.
    """

    def cut(t: Column) -> Column:
        out = None
        # Two numbers need two brackets, or a digit with a full stop and a blank twice: most parts have neither.
        twice = (F.length(F.substring_index(t, "[", 2)) < F.length(t), t.rlike(r"(?s)\d\.\s.*\d\.\s"))
        for likely, start in zip(twice, MERGED, strict=True):
            pieces = F.filter(F.transform(F.split(F.regexp_replace(t, start, "\u0001"), "\u0001"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > 15)
            found = likely & (F.regexp_count(t, F.lit(start)) >= 2)
            out = F.when(found, pieces) if out is None else out.when(found, pieces)
        return out.otherwise(F.filter(F.array(t), lambda p: p != ""))

    whole = F.coalesce(part, F.lit(""))
    # The look ahead comes first: it fails at once at most places, where the look behind tries forty lengths.
    return bound(F.when(whole.contains("["), F.regexp_replace(whole, r"(?=\s[\d\s]*\])(?<=\[[\d\s]{0,40})\s+(?=[\d\s]*\])", "")).otherwise(whole), cut)


#: A key of letters and two digits in brackets, and a bracketed number at a reference's start.
LETTER_KEY = r"(?<![\p{L}\p{N}_])(?=\[[A-Za-z][A-Za-z0-9+]*\d{2}[a-z]?\]\s+)"
NUMBERED = r"^\s*\[\d+\]"


def listed_references(text: Column) -> Column:
    """The references of a bibliography, however they are marked: an array of texts, empty for null.

    Five keys of letters or more cut it at each key, what stands before the first one left out; else it is split
    as a manuscript's and merged numbers are cut apart. Where half of the references and two at least have
    bracketed numbers, those without are left out.
    """
    t = F.coalesce(text, F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pieces = F.split(F.regexp_replace(t, LETTER_KEY, "\u0001"), "\u0001")
    lettered = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), trimmed)
    found = F.when(F.size(pieces) > 5, lettered).otherwise(F.flatten(F.transform(split_bibliography(t), unmerged)))
    numbered = F.filter(found, lambda r: r.rlike(NUMBERED))
    return F.when(F.size(numbered) >= F.greatest(F.lit(2), F.floor(F.size(found) / 2)), numbered).otherwise(found)


def marker_counts(body: Column) -> Column:
    """How many markers of each family a text has, in the families' order."""
    return F.struct(*[F.regexp_count(F.coalesce(body, F.lit("")), F.lit(p)).cast("long").alias(k) for k, p in MARKERS.items()])


def dominant_style(counts: Column) -> Column:
    """The family with most markers, the first of equals; UNKNOWN where there are none."""
    names = list(MARKERS)
    most = F.greatest(*[counts[k] for k in names])
    return F.when(most == 0, "UNKNOWN").otherwise(F.coalesce(*[F.when(counts[k] == most, k) for k in names]))


def markers(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row for each bracketed numeric marker: its number, text and keys."""
    from quillstone.functions.identifiers import unroll

    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(MARKERS["NUMERIC_BRACKETED"]), F.lit(1))
    each = df.select(key, F.posexplode(found).alias("position", "marker"))
    return each.select(key, "position", "marker", unroll(F.col("marker")).alias("keys"))


def citation_fields(raw: Column) -> Column:
    """Year, pages, volume, issue, quoted or leading title and authors of one reference."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "), r"^\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|\d+[.)])\s*", ""))
    none = lambda c: F.nullif(c, F.lit(""))
    year = F.coalesce(none(F.regexp_extract(clean, YEAR_ANYWHERE, 1)), none(F.regexp_extract(clean, YEAR_BARE, 1))).try_cast("int")
    pages = F.coalesce(none(F.regexp_extract(clean, PAGES, 1)), none(F.regexp_extract(clean, r"\b(\d{1,5}\s*[-–—]\s*\d{1,5})\b", 1)), none(F.regexp_extract(clean, r"\b(e\d{4,8}|\d{5,8})\.?$", 1)), F.lit(""))
    volume = F.coalesce(none(F.regexp_extract(clean, r"\b(\d{1,4})\s*\(\s*(\d{1,3})\s*\)", 1)), none(F.regexp_extract(clean, r"(?i)\bvol(?:ume)?\.?\s*(\d{1,4})", 1)), none(F.regexp_extract(clean, r",\s*(\d{1,4}),\s*(\d{1,4}),\s*pp", 1)), F.lit(""))
    issue = F.coalesce(none(F.regexp_extract(clean, r"\b(\d{1,4})\s*\(\s*(\d{1,3})\s*\)", 2)), none(F.regexp_extract(clean, r"(?i)\bno\.?\s*(\d{1,4})", 1)), none(F.regexp_extract(clean, r",\s*(\d{1,4}),\s*(\d{1,4}),\s*pp", 2)), F.lit(""))
    quoted = r"^(.*?)[\"“](.*?)[\"”](.*)$"
    dated = r"^(.*?)\(\s*(?:18|19|20)\d{2}[a-z]?\s*\)\.?\s*([^.]+)\.\s*(.*)$"
    listed = r"^([^,]+(?:,\s*[A-Z][^,]{0,3})*),\s*([^,]+),\s*([^,]+)"
    pick = lambda q, d, c: F.when(clean.rlike(quoted), F.regexp_extract(clean, quoted, q)).when(clean.rlike(dated), F.regexp_extract(clean, dated, d)).when(clean.rlike(listed), F.regexp_extract(clean, listed, c)).otherwise("")
    trim = lambda c: F.regexp_replace(F.trim(c), r"^[,;.\s]+|[,;.\s]+$", "")
    return F.struct(
        trim(pick(1, 1, 1)).alias("cited_authors"), trim(pick(2, 2, 2)).alias("cited_title"), trim(pick(3, 3, 3)).alias("cited_journal"),
        volume.alias("cited_volume"), issue.alias("cited_issue"), F.regexp_replace(pages, r"\s+", "").alias("cited_pages"), year.alias("cited_year"),
    )


#: Headings of a bibliography and of what may follow it.
REFERENCE_HEADING = r"(?im)^[ \t]*(?:\d+\.?|[IVX]+\.?)?[ \t]*(?:references|bibliography|works cited|literature cited|reference list)[ \t]*:?[ \t]*$"
TRAILING_HEADING = r"(?im)^[ \t]*(?:appendix|appendices|supplementary material|acknowledge?ments?|author contributions|about the authors?)\b.*$"


def manuscript_parts(text: Column) -> Column:
    """(body, bibliography): cut at the first bibliography heading after 30 % of the text; no heading, no bibliography."""
    skip = F.floor(F.length(text) * 0.3).cast("int")
    tail = F.substring(text, skip + 1, F.length(text))
    at = F.regexp_instr(tail, F.lit(REFERENCE_HEADING))
    after = F.regexp_replace(F.substring(tail, at, F.length(tail)), r"^[^\n]*\n?", "")
    end = F.regexp_instr(after, F.lit(TRAILING_HEADING))
    refs = F.when(end > 101, F.substring(after, F.lit(1), end - 1)).otherwise(after)
    return F.when(at > 0, F.struct(F.trim(F.substring(text, F.lit(1), skip + at - 1)).alias("body"), F.trim(refs).alias("bibliography"))).otherwise(F.struct(F.trim(text).alias("body"), F.lit("").alias("bibliography")))


def sections(df: DataFrame, key: str, text: str, heading: Column) -> DataFrame:
    """Sections of each document: every line that ``heading`` (over a column ``line``) accepts starts one.

    A document's lines stay with it; text before the first heading is section 0. Offsets are code points.
    """
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no")
    numbered = lines.withColumn("section", F.sum(heading.cast("int")).over(w)).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.groupBy(key, "section").agg(
        F.min_by("line", "no").alias("title"), F.count("*").alias("n_lines"), F.min("start").alias("start_offset"), F.max(F.col("start") + F.length("line")).alias("end_offset"),
    )


def chunks(units: Column, limit: int, overlap: int) -> Column:
    """Units (strings) packed into chunks of at most ``limit`` code points, joined by blank lines.

    The last unit of a chunk opens the next one where it is no longer than ``overlap`` and fits.
    """
    kind = "struct<held: array<string>, size: int, fresh: boolean, done: array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"), F.lit(False).alias("fresh"), F.array().cast("array<string>").alias("done")).cast(kind)

    def step(acc: Column, u: Column) -> Column:
        n = F.length(u)
        over = (F.size(acc["held"]) > 0) & (acc["size"] + n + 2 > limit)
        last = F.element_at(acc["held"], F.greatest(F.lit(1), F.size(acc["held"])))
        carry = over & (F.length(last) <= overlap) & (F.length(last) + n + 2 <= limit)
        held = F.when(carry, F.array(last, u)).when(over, F.array(u)).otherwise(F.concat(acc["held"], F.array(u)))
        size = F.when(carry, F.length(last) + n + 2).when(over, n).otherwise(acc["size"] + n + F.when(F.size(acc["held"]) > 0, 2).otherwise(0))
        done = F.when(over, F.concat(acc["done"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["done"])
        return F.struct(held.alias("held"), size.cast("int").alias("size"), F.lit(True).alias("fresh"), done.alias("done")).cast(kind)

    return F.aggregate(units, start, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["done"]))


def metric_candidates(stdout: Column, metric: str) -> Column:
    """Numbers that a log gives for a metric: final summaries where there are any, else ``metric = number``."""
    import re

    words = r"[\s_-]+".join(re.findall(r"[A-Za-z0-9]+", metric))
    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    final = F.regexp_extract_all(stdout, F.lit(rf"(?im)^\s*final\s+(?:[A-Za-z]+\s+)?{words}\s*[:=]?\s*{number}"), F.lit(1))
    plain = F.regexp_extract_all(stdout, F.lit(rf"(?i)\b{words}\s*[:=]\s*{number}"), F.lit(1))
    return F.transform(F.when(F.size(final) > 0, final).otherwise(plain), lambda x: x.try_cast("double"))


def observed(candidates: Column, status: Column, intact: Column) -> Column:
    """(status, value) of a run: one candidate is extracted, more are ambiguous even if equal."""
    n = F.size(candidates)
    state = F.when(status != "COMPLETED", "UNAVAILABLE").when(~intact, "INVALID").when(n == 0, "NOT_FOUND").when(n > 1, "AMBIGUOUS").otherwise("EXTRACTED")
    return F.struct(state.alias("status"), F.when(state == "EXTRACTED", F.get(candidates, F.lit(0))).alias("value"))


def requirements(df: DataFrame, path: str, content: str) -> DataFrame:
    """Dependencies of requirement files: name, constraint and evidence line; comments, options and URLs give none."""
    lines = df.select(path, F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n")).alias("no", "line"))
    clean = F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", ""))
    kept = lines.withColumn("clean", clean).filter((F.col("clean") != "") & ~F.col("clean").rlike(r"^-|://|^git\+"))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*((?:[=<>~!]=?=?|===)[^;]*)?"
    return kept.filter(F.col("clean").rlike(shape)).select(path, (F.col("no") + 1).alias("line_no"), F.lower(F.regexp_extract("clean", shape, 1)).alias("name"), F.trim(F.regexp_extract("clean", shape, 2)).alias("version_constraint"), F.trim("line").alias("evidence"))


#: How reported parameters are written.
PARAMETERS = {
    "learning_rate": r"(?i)\blearning[ _-]?rate\b\s*(?:of|=|:|was|is)?\s*([0-9]+(?:\.[0-9]+)?(?:e[+-]?\d+)?)",
    "batch_size": r"(?i)\bbatch[ _-]?size\b\s*(?:of|=|:|was|is)?\s*(\d+)",
    "epochs": r"(?i)\b(?:number of )?epochs?\b\s*(?:of|=|:|was|is)?\s*(\d+)",
    "optimizer": r"(?i)\boptimizer\b\s*(?:of|=|:|was|is)?\s*([A-Za-z][A-Za-z0-9_-]*)",
    "seed": r"(?i)\b(?:random )?seed\b\s*(?:of|=|:|was|is)?\s*(\d+)",
    "temperature": r"(?i)\btemperature\b\s*(?:of|=|:|was|is)?\s*([0-9]+(?:\.[0-9]+)?)",
}


def parameters(df: DataFrame, key: str, text: str) -> DataFrame:
    """Parameters that lines report: one row for each line, name and value."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.regexp_extract("line", p, 1).alias("value")) for k, p in PARAMETERS.items()]), lambda x: x["value"] != "")
    return lines.select(key, "no", F.explode(found).alias("p")).select(key, "no", "p.name", "p.value")
