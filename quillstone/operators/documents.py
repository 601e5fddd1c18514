"""Documents cut into sections, and the context that a reader of limited length gets of them (SC70, TVF09, TVF12).

Lines are rows: whether one is a heading, where sections begin and what they hold follow by windows within a document.
The budget is a fold over a document's few sections, within its row: each takes as much of the rest as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import citations, context
from quillstone.functions.artifacts import SECTIONS, first_rule

#: How headings are numbered, captions and entries that are none, and headings without a number.
NUMBERED_HEADING, ROMAN_HEADING = r"^\s*\d+(?:\.\d+)*\.?\s+([A-Z][^.!?]{1,90})\s*$", r"^\s*[IVXLC]+\.?\s+([A-Z][^.!?]{1,90})\s*$"
CAPTION, ENTRY = r"(?i)^(?:table|figure|fig\.?|equation|eq\.?)\s*\d", r"^(?:\[\d+\]|\d+\.)\s+[A-Z][a-z]+,?\s+[A-Z]"
UNNUMBERED = (
    "abstract", "summary", "introduction", "background", "related_work", "prior_work", "literature_review", "method", "methods", "methodology", "approach", "model_architecture", "model_architecture_and_training", "training_procedure",
    "data", "dataset", "datasets", "experiments", "experimental_setup", "experimental_results", "results", "results_and_discussion", "evaluation", "discussion", "discussion_and_conclusion", "conclusion", "conclusions", "limitations",
    "appendix", "appendices", "references", "bibliography", "works_cited", "reference_list",
)
#: Kinds of sections by priority, and the default limits in code points.
HIGH = ("ABSTRACT", "INTRODUCTION", "METHODS", "METHODOLOGY", "MODEL", "DATA", "DATASET", "EXPERIMENTS", "EXPERIMENTAL_SETUP", "RESULTS", "EVALUATION", "DISCUSSION", "CONCLUSION")
LOW = ("RELATED_WORK", "BACKGROUND", "LIMITATIONS", "APPENDIX")
TOTAL, INPUT, CHUNK, OVERLAP, TITLE = 120_000, 45_000, 40_000, 500, 4_000
LINE = r"([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+)"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Words of headings whose first letter small capitals part from the rest.
PARTED = "abstract background conclusion conclusions data dataset datasets discussion evaluation experiment experiments implementation introduction limitations method methods methodology references related result results".split()


def heading_form(title: Column) -> Column:
    """A heading without its number, parted words mended, lower case, with _ for all but letters and digits."""
    bare = F.regexp_replace(_stripped(title), r"(?i)^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)\.?\s+", "")
    parted = "(?i)" + "|".join(rf"(?<=\b{word[0]}) (?={word[1:]}\b)" for word in PARTED)
    bare = F.regexp_replace(bare, parted, "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_heading(line: Column) -> Column:
    """Whether a line reads as a section's heading: numbered and short, or one of the usual ones alone."""
    value = F.regexp_replace(_stripped(line), r"(?U)\s+", " ")
    words = F.size(F.split(value, " "))
    number = F.coalesce(F.nullif(F.regexp_extract(value, NUMBERED_HEADING, 1), F.lit("")), F.nullif(F.regexp_extract(value, ROMAN_HEADING, 1), F.lit("")))
    numbered = number.isNotNull() & (F.size(F.split(F.trim(number), " ")) <= 10)
    usual = lambda c: heading_form(c).isin(*UNNUMBERED)
    return (
        F.when((value == "") | (F.length(value) > 100) | (words > 12) | value.rlike(CAPTION) | value.rlike(ENTRY), False)
        .when(value.endswith(":"), usual(F.regexp_replace(value, ":$", "")))
        .when(value.rlike(r"[.;,]$"), False).when(number.isNotNull(), numbered).otherwise(usual(value))
    )


def kind_of(heading: Column) -> Column:
    """The kind of section that a heading starts, broken small capitals mended."""
    return first_rule(F.replace(heading_form(heading), F.lit("_"), F.lit(" ")), SECTIONS, "OTHER")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per section: key, number, section_type, title, start, end (code points) and text.

    What stands before the first heading is a section ``Document header`` of type TITLE. After the heading of the
    references no line is a heading. Sections without text, null and blank texts have no row. Rows with one key
    count as one document.
    """
    lines = df.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")).select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(LINE), F.lit(1))).alias("no", "raw"))
    # One exchange by document serves all windows and the gathering of the sections.
    lines = lines.repartition("key").withColumn("line", _stripped(F.col("raw"))).withColumn("heading", is_heading(F.col("line"))).withColumn("kind", F.when(F.col("heading"), kind_of(F.col("line"))))
    w = Window.partitionBy("key").orderBy("no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"offset": F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)), "listed": F.coalesce(F.max(F.col("kind") == "REFERENCES").over(before), F.lit(False))})
    lines = lines.withColumn("heading", F.col("heading") & ~F.col("listed")).withColumn("section", F.sum(F.col("heading").cast("int")).over(w))
    first = lambda c: F.min_by(c, "no")
    start = F.when(F.col("heading"), F.col("offset") + F.length(F.regexp_extract("raw", r"(?U)^(\s*)", 1))).otherwise(F.col("offset"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "raw"))), lambda x: x["raw"]), "")
    out = lines.groupBy("key", "section").agg(
        first(F.when(F.col("heading"), F.col("kind")).otherwise("TITLE")).alias("section_type"), first(F.when(F.col("heading"), F.col("line")).otherwise("Document header")).alias("title"),
        first(start).cast("long").alias("start"), F.max(F.col("offset") + F.length("raw")).alias("last"), _stripped(whole).alias("text"),
    )
    of_key = Window.partitionBy("key").orderBy("section")
    out = out.withColumn("end", F.coalesce(F.lead("start").over(of_key), F.col("last")).cast("long")).filter("text <> ''")
    return out.select(F.col("key").alias(key), F.row_number().over(of_key).alias("number"), "section_type", "title", "start", "end", "text")


SELECTED = "array<struct<start: bigint, section_type: string, title: string, priority: string, text: string>>"


def _selected(ranked: Column, total: int) -> Column:
    """The sections that fit in ``total`` code points, in their ranks' order, each as far as whole paragraphs or sentences go."""
    kind = f"struct<rest: int, kept: {SELECTED}>"

    def step(acc: Column, s: Column) -> Column:
        room = F.when(s["section_type"] == "TITLE", F.least(F.lit(TITLE), acc["rest"])).otherwise(acc["rest"])
        priority = F.when(s["section_type"].isin("TITLE", *HIGH), "HIGH").when(s["section_type"].isin(*LOW), "LOW").otherwise("MEDIUM")
        # The cut is made once, in an array of one, and used three times.
        made = F.transform(F.array(F.when(acc["rest"] > 0, context.semantic_prefix(s["text"], room)).otherwise("")), lambda cut: F.struct(
            (acc["rest"] - F.length(cut)).alias("rest"),
            F.when(cut == "", acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(s["start"].alias("start"), s["section_type"].alias("section_type"), s["title"].alias("title"), priority.alias("priority"), cut.alias("text"))))).alias("kept"),
        ).cast(kind))
        return F.element_at(made, 1)

    zero = F.struct(F.lit(total).alias("rest"), F.array().cast(SELECTED).alias("kept")).cast(kind)
    return F.aggregate(ranked, zero, step, lambda acc: F.array_sort(acc["kept"]))


def prepare(df: DataFrame, key: str, text: str, total: int = TOTAL, most: int = INPUT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: the selected sections, the chunks made of them, and what happened on the way.

    Sections but the references share ``total`` code points: the title's first (4,000 at most), then those of high
    priority, others, and those of low priority, by their place in the text. Where fewer than two sections are found, or
    none of high priority, front and end of the whole text stand for them (``fallback``). Chunks have ``chunk`` code
    points, at most ``most``, but for a label's; the last unit of one opens the next if it has ``overlap`` or fewer.
    Null and blank texts have no sections and no chunks.
    """
    limit = min(chunk, most)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be smaller than a chunk")
    found = sections(df, key, text)
    rank = F.when(F.col("section_type") == "TITLE", 0).when(F.col("section_type").isin(*HIGH), 1).when(F.col("section_type") == "OTHER", 2).otherwise(3)
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "section_type", "title", "text")))
    per = found.groupBy(key).agg(listed.alias("all"))
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("whole")).join(per, key, "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<rank: int, start: bigint, section_type: string, title: string, text: string>>")))
    substantive = F.filter("all", lambda s: ~s["section_type"].isin("TITLE", "REFERENCES"))
    reliable = (F.size(substantive) >= 2) & F.exists(substantive, lambda s: s["section_type"].isin(*HIGH))
    bounded = context.bounded_text(F.col("whole"), total)
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit("OTHER").alias("section_type"), F.lit("Bounded full text").alias("title"), F.lit("FALLBACK").alias("priority"), bounded.alias("text"))).cast(SELECTED)
    selected = F.when(reliable, _selected(F.filter("all", lambda s: s["section_type"] != "REFERENCES"), total)).when(F.col("whole").rlike(r"(?U)\S"), one).otherwise(F.array().cast(SELECTED))
    rows = rows.withColumns({"fallback": ~reliable, "selected": selected})

    def units(s: Column) -> Column:
        label = F.concat(F.lit("["), s["section_type"], F.lit(": "), s["title"], F.lit("]"))
        room = F.greatest(F.lit(500), F.lit(limit - 2) - F.length(label))
        return F.transform(context.large_text(s["text"], room), lambda piece: F.concat(label, F.lit("\n"), piece))

    rows = rows.withColumn("chunks", citations.chunks(F.flatten(F.transform("selected", units)), limit, overlap))
    size = lambda c, of: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(of(x)))
    return rows.select(
        key, "fallback", F.length("whole").cast("long").alias("total_characters"), F.size("all").alias("sections_detected"), "selected", size("selected", lambda x: x["text"]).alias("selected_characters"),
        "chunks", F.size("chunks").alias("chunks_created"), size("chunks", lambda x: x).alias("input_characters"),
    )
