"""Bibliographies and citation markers as rows: author-date entries, all strategies of splitting, markers with offsets (TVF02, TVF04, TVF07, AG24).

Lines, entries and markers are found within the row of their text, in time that grows with it, so that nothing is
shuffled. A document is a row, named by the column ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.citations import MARKERS, unmerged
from quillstone.functions.identifiers import unroll
from quillstone.functions.spread import spread
from quillstone.functions.text import around, bound, located, stretches

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EDGE_BLANKS, BLANKS = r"(?U)^\s+|\s+$", r"(?U)\s+"
#: A text of ASCII words with one space between them, which squeezing leaves as it is.
PLAIN = r"^[!-~]++(?: [!-~]++)*+\z"

#: What a running head looks like, what starts an entry, what ends the one before.
RUN_ON = r"(?U)((?:18|19|20)\d{2}[a-z]?\.)\s+(?=[A-Z][a-z][A-Za-z'\-]*(?:\s+(?:[A-Z]\.|[A-Z][a-z][A-Za-z'\-]*)){1,5}(?:(?:\s+et\s+al\.)|\.|,|\s+and\s+))"
RUNNING_HEAD = r"(?iU)^(?:JOURNAL\s*OF\s*[A-Za-z\s]+|[A-Z\s]{4,}\s+\d{1,4}|\d{1,4}\s+[A-Z\s\.\,\'\-]{4,})$"
DATED_AUTHOR = r"(?U)^[A-ZÀ-ɏ][a-zA-ZÀ-ɏ\s\.\,\'\-]{1,60}?(?:,\s*|\.\s*|\s+)(?:(?:19|20)\d{2}[a-z]?|n\.d\.[a-z]?|\((?:19|20)\d{2}[a-z]?\))\s*[\.\:\,\)]"
CORPORATE_AUTHOR = r"(?iU)^(?:Google|World\s+Health\s+Organization|National\s+Institutes\s+of\s+Health|IEEE(?!\s+(?:Conference|Transactions|Journal)\b)|ACM|APA|ISO|W3C|National\s+Research\s+Council)\b"
INVERTED_AUTHOR = r"(?U)^[A-ZÀ-ɏ][a-zA-ZÀ-ɏ\s\.\,\'\-]{1,40},\s+[A-ZÀ-ɏ]"
ENDED = r"(?U)[\.\?\!\"”\’\)\/]\s*$|[a-z0-9]\.html?\s*$|[0-9]{5,}\s*$"
LINKED = r"(?iU)doi\.org\/|http|\.html?|\.php|\d{4}\.\d{4,}"
SOCIETY = r"(?iU)^(?:IEEE|ACM)\s+(?:Conference|Transactions|Journal)\b"
ONE_AUTHOR = r"(?U)^[A-Z][a-z][A-Za-z'\-]+(?:\s+[A-Z]\.)?\s+[A-Z][a-z][A-Za-z'\-]+(?:\s+et\s+al)?\.\s+[A-Z]"
COMPLETE = r"(?U)(?i:(?<!\d)(?:18|19|20)\d{2}[a-z]?\.\s*$)|\b(?:a|b)\.\s*$|\d{4,9}\.\s*$"
COMPLETE_LINK = r"(?iU)(?:arxiv\.org|doi\.org|aclanthology\.org)/\S+\.?\s*$"
PAGE_NUMBER, NUMBER_AT_END, LINK = r"(?U)^\d{1,3}$", r"(?U)\d+\.\s*$", r"(?i)https?://"
#: Code points at the end of a line that tell whether it ends an entry: a year, a letter and a full stop are six.
TAIL = 16
#: Code points of a line that are looked at for an author, names that an author has, the shortest entry.
LOOKED_AT, NAMES, SHORTEST = 320, (2, 7), 15


def _stripped(c: Column) -> Column:
    """Without blanks at the ends; a look at the first and the last character spares most texts the work."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, EDGE_BLANKS, "")).otherwise(c)


def _squeezed(c: Column) -> Column:
    """With one space for any blanks; most texts are seen to be so at one look."""
    return F.when(c.rlike(PLAIN), c).otherwise(_stripped(F.when(c.rlike(r"(?U)\s\s|[^\S ]"), F.regexp_replace(c, BLANKS, " ")).otherwise(c)))


def _tail(line: Column) -> Column:
    """The end of a line without blanks there: more than ENDED, COMPLETE and NUMBER_AT_END look at."""
    return F.when(F.length(line) > TAIL, F.substring(line, -TAIL, TAIL)).otherwise(line)


def reads_as_author_list(line: Column) -> Column:
    """Whether a line may start an entry whose year comes last: one author and a title, or a list that starts with a name."""

    def named(first: Column) -> Column:
        names = F.regexp_count(first, F.lit(r"(?U)\S+"))
        capital = F.substring(first, 1, 1)
        return (capital == F.upper(capital)) & (capital != F.lower(capital)) & ~first.rlike(r"\d") & names.between(*NAMES)

    def read(head: Column) -> Column:
        listed = (head.contains(",") | head.contains(" and ")) & bound(_stripped(F.substring_index(F.substring_index(head, ",", 1), " and ", 1)), named)
        return head.rlike(ONE_AUTHOR) | listed

    return bound(F.substring(line, 1, LOOKED_AT), read) & ~line.rlike(PAGE_NUMBER) & ~line.rlike(SOCIETY)


def author_date_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per entry of each unnumbered bibliography: key, number (from 1) and raw. Null and empty texts give no row."""
    each = df.select(F.col(key).alias("key"), F.posexplode(author_date_entries(F.col(text))).alias("number", "raw"))
    return each.select(F.col("key").alias(key), (F.col("number") + 1).alias("number"), "raw")


def author_date_entries(text: Column) -> Column:
    """Array of the entries of an unnumbered bibliography.

    Two readings are made side by side. In the first, a line starts an entry if it starts with an author and the line
    before it ended one. In the second, for entries with the year last, it starts one if it reads as an author list and
    the lines held so far are complete: their end says so, or it is a number and a link is among them. Whether a link is
    depends on where the entry began; with ``open`` lines as those that would start an entry after a link or a complete
    end, an entry holds a link if no open line comes after the last link. The reading with more entries is kept, the
    first of equals. Entries of 15 characters or fewer are none.
    """
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), RUN_ON, "$1\n"), LINE_END), _stripped), lambda x: (x != "") & ~x.rlike(RUNNING_HEAD))
    numberless = lambda of: F.filter(of, lambda x: ~x.rlike(PAGE_NUMBER))
    more = lambda one, two: F.when(F.size(two) > F.size(one), two).otherwise(one)
    read = lambda of: bound(_entries(of, _ends_by_author(of)), lambda one: bound(numberless(of), lambda rest: bound(_entries(rest, _ends_by_year(rest)), lambda two: more(one, two))))
    return F.transform(bound(lines, read), _squeezed)


def _entries(lines: Column, ends: Column) -> Column:
    """The lines joined to entries, cut after some places."""
    return F.filter(F.transform(stretches(lines, ends), lambda x: F.array_join(x, " ")), lambda raw: F.length(_stripped(raw)) > SHORTEST)


def _ends_by_author(lines: Column) -> Column:
    """The places of lines that end an entry where the next one starts with an author."""
    dated = lambda line: line.rlike(DATED_AUTHOR) | line.rlike(CORPORATE_AUTHOR) | line.rlike(INVERTED_AUTHOR)
    places = F.when(F.size(lines) > 1, F.sequence(F.lit(1), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    ended = lambda prev: _tail(prev).rlike(ENDED) | prev.rlike(LINKED)
    return F.filter(places, lambda i: dated(F.element_at(lines, i + 1)) & ended(F.element_at(lines, i)))


def _ends_by_year(lines: Column) -> Column:
    """The places of lines that end an entry where the next one reads as an author list."""

    def judged(line: Column, prev: Column) -> Column:
        done = F.coalesce(_tail(prev).rlike(COMPLETE) | (prev.contains("/") & prev.rlike(COMPLETE_LINK)), F.lit(False))
        opens = lambda d: (d | F.coalesce(_tail(prev).rlike(NUMBER_AT_END), F.lit(False))) & reads_as_author_list(line)
        said = lambda d: bound(opens(d), lambda o: F.struct((o & d).alias("done"), o.alias("open"), (line.contains("://") & line.rlike(LINK)).alias("link")))
        return bound(done, said)

    def step(acc: Column, x: Column) -> Column:
        cut = x["open"] & (x["done"] | acc["link"])
        link = F.when(x["open"], x["link"]).otherwise(acc["link"] | x["link"])
        return F.struct((acc["at"] + 1).alias("at"), link.alias("link"), F.when(cut, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"]).alias("ends"))

    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("link"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(F.zip_with(lines, F.slice(before, F.lit(1), F.size(lines)), judged), zero, step, lambda acc: acc["ends"])


#: How numbered entries start, at a line's start or anywhere, and where a text is cut before them; first a sign that all of them have.
AFTER = r"(?:^|(?<=[\s.>)\]\"”’]))"
NEXT = r"(?=[A-ZÀ-ɏ\"“])"
STRATEGIES = (
    ("[", r"(?m)^\s*\[(\d+)\]\s+", r"(?m)(?=^\s*\[\d+\]\s+)", False),
    ("[", rf"{AFTER}\[(\d{{1,3}})\]\s*{NEXT}", rf"(?={AFTER}\[\d{{1,3}}\]\s*[A-ZÀ-ɏ\"“])", False),
    (".", r"(?m)^\s*(\d+)\.\s+", r"(?m)(?=^\s*\d+\.\s+)", True),
    (".", rf"{AFTER}\s*(\d{{1,3}})\.\s+{NEXT}", rf"(?={AFTER}\s*\d{{1,3}}\.\s+[A-ZÀ-ɏ\"“])", True),
    ("(", r"(?m)^\s*\((\d+)\)\s+", r"(?m)(?=^\s*\(\d+\)\s+)", False),
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: The look ahead comes first: it fails at once at most places, where the look behind tries forty lengths.
SPREAD_NUMBER = r"(?=\s[\d\s]*\])(?<=\[[\d\s]{0,40})\s+(?=[\d\s]{0,40}\])"


def _cleaned(text: Column) -> Column:
    whole = _stripped(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " "))
    return bound(whole, lambda t: F.when(t.contains("["), F.regexp_replace(t, SPREAD_NUMBER, "")).otherwise(t))


def _longer(parts: Column, least: int) -> Column:
    return F.transform(F.filter(parts, lambda p: F.length(_stripped(p)) > least), _squeezed)


def numbered_references(cleaned: Column) -> Column:
    """Array of the entries of a numbered bibliography, null where no numbering gives two of them.

    Brackets go before full stops before parentheses; numbers with full stops have to begin with 1 and 2. Entries that
    a line holds together are cut apart.
    """
    return F.flatten(F.transform(F.coalesce(*[F.when(cleaned.contains(sign), _by_marks(cleaned, *of)) for sign, *of in STRATEGIES]), unmerged))


def _by_marks(cleaned: Column, marks: str, cut: str, from_one: bool) -> Column:
    """The entries by one way of numbering, null where it does not give two."""

    def parts(found: Column) -> Column:
        ok = F.size(found) >= 2
        if from_one:
            ok = ok & (F.transform(F.slice(found, 1, 2), lambda n: n.try_cast("int")) == F.array(F.lit(1), F.lit(2)))
        return F.when(ok, bound(_longer(F.split(cleaned, cut), SHORTEST), lambda of: F.when(F.size(of) >= 2, of)))

    return bound(F.regexp_extract_all(cleaned, F.lit(marks), F.lit(1)), parts)


def loose_references(cleaned: Column) -> Column:
    """Array of the entries of any other bibliography: paragraphs, what semicolons part, lines, or the whole text."""
    paragraphs = _longer(F.split(cleaned, r"(?U)\n\s*\n+"), 20)
    listed = F.filter(F.transform(F.split(cleaned, ";"), _stripped), lambda p: F.length(p) > SHORTEST)
    lines = _longer(F.split(cleaned, LINE_END), 25)
    return (
        F.when(F.size(paragraphs) >= 2, F.flatten(F.transform(paragraphs, unmerged)))
        .when(cleaned.contains(";") & (F.size(listed) >= 2), listed)
        .when(F.size(lines) >= 2, lines)
        .otherwise(F.filter(F.array(_squeezed(cleaned)), lambda p: p != ""))
    )


def manuscript_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per entry of each bibliography, by the first strategy that gives two: key, strategy, number and raw.

    Numbered entries come first, then author-date ones, then paragraphs, semicolons and lines; a text that none of
    them cuts is one entry. Null and blank texts give no row.
    """
    named = lambda strategy, parts: F.struct(F.lit(strategy).alias("strategy"), parts.alias("parts"))
    other = lambda t: bound(author_date_entries(t), lambda dated: F.when(F.size(dated) >= 2, named("author_date", dated)).otherwise(named("loose", loose_references(t))))
    first = lambda t: bound(numbered_references(t), lambda numbered: F.when(numbered.isNotNull(), named("numbered", numbered)).otherwise(other(t)))
    # Arrays of one, exploded: what is in them is worked out once for each row, however often it is used.
    rows = df.select(F.col(key).alias("key"), F.explode(F.array(bound(_cleaned(F.col(text)), first))).alias("x"))
    each = rows.select("key", F.col("x.strategy").alias("strategy"), F.posexplode("x.parts").alias("number", "raw"))
    return each.select(F.col("key").alias(key), "strategy", (F.col("number") + 1).alias("number"), "raw")


#: The narrative form, words before a year that are no authors, and what a number in parentheses may be instead.
NARRATIVE = r"(?U)\b([A-Z][A-Za-zÀ-ɏ\-']+(?:\s+(?:&|and)\s+[A-Z][A-Za-zÀ-ɏ\-']+|\s+et\s+al\.)?)\s*(?:and\s+[a-z\s]+)?\(\s*((?:18|19|20)\d{2}[a-z]?|n\.d\.[a-z]?)(?:,\s*(?:p{1,2}\.?\s*)?\d{1,4})?\s*\)"
NO_AUTHORS = ("table", "figure", "fig", "section", "equation", "eq", "step", "article", "date")
PARENTHESIZED = r"(?<![A-Za-z0-9_])\(\s*(\d+(?:\s*[-–—,;]\s*\d+)*)\s*\)(?![A-Za-z0-9_])"
NO_CITATION = r"(?iU)\b(eq|equation|formula|step|clause|case|figure|fig|table)\b"
ENUMERATION = r"(?U)\(\s*\d+\s*\)\s+[A-Z][a-z]+"
NOTE = r"(?iU)\[(?:Footnote|Note)\]\s*(\d{1,4})?\.?\s*([^\n]*?)(?=\n|\[(?:Footnote|Note)\]|$)"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻–—", "0123456789---"
FIRST_YEAR = 1900
CONTEXT = 120
#: The families in the order in which ties are settled, with the forms of each and their patterns.
FAMILIES = ("NUMERIC_BRACKETED", "AUTHOR_YEAR", "NUMERIC_SUPERSCRIPT", "NUMERIC_PARENTHETICAL", "FOOTNOTE_NOTE")
FORMS = (
    ("NUMERIC_BRACKETED", "NUMERIC_BRACKETED", "(?U)" + MARKERS["NUMERIC_BRACKETED"]),
    ("AUTHOR_YEAR_PARENTHETICAL", "AUTHOR_YEAR", "(?U)" + MARKERS["AUTHOR_YEAR"]),
    ("AUTHOR_YEAR_NARRATIVE", "AUTHOR_YEAR", NARRATIVE),
    ("NUMERIC_SUPERSCRIPT", "NUMERIC_SUPERSCRIPT", MARKERS["NUMERIC_SUPERSCRIPT"]),
    ("NUMERIC_PARENTHETICAL", "NUMERIC_PARENTHETICAL", "(?U)" + PARENTHESIZED),
    ("FOOTNOTE_NOTE", "FOOTNOTE_NOTE", NOTE),
)


def scan_markers(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row per citation marker of each text: key, family, form, place, marker, content, keys, author, year, context, start, end.

    ``start`` and ``end`` are code points; ``place`` numbers the markers of a family within a text, parenthetical forms
    before narrative ones. Numbers in parentheses count only outside of equations, steps and enumerations and below
    1900, superscripts only if a number is read from them; a note without a number is keyed by its place. Null and
    empty texts give no row.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    none, families = F.lit(None).cast("string"), {}
    for form, family, pattern in FORMS:
        found = located(text, pattern, 1, 2) if form in ("AUTHOR_YEAR_NARRATIVE", "FOOTNOTE_NOTE") else located(text, pattern, 1)
        families.setdefault(family, []).append(F.filter(F.transform(found, _marker(text, form, none)), lambda m: m["fits"]))
    numbered = [F.transform(F.concat(*of), lambda m, i: m.withField("place", i + 1)) for of in families.values()]
    rows = spread(df.select(F.col(key).alias("key"), F.col(body).alias(body))).select("key", F.explode(F.concat(*numbered)).alias("m"))
    # A note without a number is keyed by its place.
    keys = F.when((F.col("m.family") == "FOOTNOTE_NOTE") & (F.size("m.keys") == 0), F.array(F.col("m.place").cast("long"))).otherwise(F.col("m.keys"))
    return rows.select(F.col("key").alias(key), "m.family", "m.form", "m.place", "m.marker", "m.content", keys.alias("keys"), "m.author", "m.year", "m.context", "m.start", "m.end")


def _marker(text: Column, form: str, none: Column):
    """What a match of a form says: family, marker, content, keys and whether it is a citation."""
    family = next(f for g, f, _ in FORMS if g == form)

    def of(x: Column) -> Column:
        one, context = x["g1"], around(text, x["start"], x["end"], CONTEXT)
        marker, content, author, year, keys, fits = x["whole"], none, none, none, F.array().cast("array<long>"), F.lit(True)
        if form == "AUTHOR_YEAR_NARRATIVE":
            author, year = _stripped(one), _stripped(x["g2"])
            marker, fits = F.concat(author, F.lit(" ("), year, F.lit(")")), ~F.lower(author).isin(*NO_AUTHORS)
        elif form == "AUTHOR_YEAR_PARENTHETICAL":
            content = one
        elif form == "FOOTNOTE_NOTE":
            number = F.nullif(one, F.lit(""))
            marker, content = F.coalesce(F.concat(F.lit("["), number, F.lit("]")), F.lit("[Footnote]")), _stripped(x["g2"])
            keys = F.array_compact(F.array(number.try_cast("long")))
        elif form == "NUMERIC_SUPERSCRIPT":
            marker, keys = one, unroll(F.translate(one, SUPERSCRIPTS, DIGITS)).cast("array<long>")
            fits = F.size(keys) > 0
        else:
            keys = unroll(one).cast("array<long>")
            if form == "NUMERIC_PARENTHETICAL":
                keys = F.filter(keys, lambda k: k < FIRST_YEAR)
                fits = (F.size(keys) > 0) & ~context.rlike(NO_CITATION) & ~context.rlike(ENUMERATION)
        return F.struct(F.lit(family).alias("family"), F.lit(form).alias("form"), F.lit(0).alias("place"), marker.alias("marker"), content.alias("content"), keys.alias("keys"), author.alias("author"), year.alias("year"), context.alias("context"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), fits.alias("fits"))

    return of


def citation_styles(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row per document: its markers of each family, and the family with most of them, the first of equals."""
    counts = scan_markers(df, key, body).groupBy(key).agg(*[F.count(F.when(F.col("family") == f, 1)).alias(f) for f in FAMILIES])
    all_ = df.select(key).distinct().join(counts, key, "left").na.fill(0, list(FAMILIES))
    most = F.greatest(*FAMILIES)
    return all_.withColumn("style", F.when(most == 0, "UNKNOWN").otherwise(F.coalesce(*[F.when(F.col(f) == most, f) for f in FAMILIES])))
