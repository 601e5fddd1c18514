"""Fill-in-middle transformation over relational units: each line of a document is a row, each cut a request for one.

The matches of a unit's pattern are exploded with their ordinals, running sums of their lengths are taken by a window,
and a document's two cuts, drawn as numbers of units, are joined with them by ordinal. The sums found, added up by
document, are the offsets at which its text is cut.

A window runs over a block of ``BLOCK`` units, so that no task has to order a whole long document: a cut asks for the
last unit of each full block before it and for its own last unit, and the sums of its answers are its offset. Only
lengths are exploded and shuffled for this; texts are shuffled once, to meet their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import name, whole_row

#: A unit is a line with its line end, or what is left after the last one.
UNIT = r"[^\n]*\n|[^\n]+"
#: The marks of the parts; a text that has one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that are transformed, and of those in the order suffix, prefix, middle.
RATE, SPM = 100, 50
SEED = "7"
#: Units that one window orders, at most.
BLOCK = 4096


def _draw(of: Column, k: int) -> Column:
    """The k-th 8-digit group of a hex digest as a long."""
    return F.conv(F.substring(of, 8 * k + 1, 8), 16, 10).cast("long")


def _between(text: Column, start: Column, end: Column | None = None) -> Column:
    """Code points of ``text`` from offset ``start`` to ``end``, or to its end."""
    return F.substr(text, start.cast("int") + 1, F.coalesce((F.length(text) if end is None else end) - start, F.lit(0)).cast("int"))


def plan_cuts(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Draw each document's form and cuts: row, doc_id, text, key, n (its units), form, first and second cut in units."""
    base = docs.select(whole_row(docs).alias("row"), name("doc_id").alias("doc_id"), F.coalesce(name("text"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    # Rows with one key are equal in all that decides their cuts and offsets.
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary")))
    base = base.withColumns({"n": F.regexp_count("text", F.lit(UNIT)).cast("long"), "digest": digest, "key": key})
    a, b = _draw(F.col("digest"), 0) % (F.col("n") + 1), _draw(F.col("digest"), 1) % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    return base.select("row", "doc_id", "text", "key", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def cut_offsets(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per key that is cut: key, first_end and second_end, code points before either cut.

    A cut before the first unit asks for nothing and has no row, or a null, here.
    """
    cut = plan.filter("form != 'plain'")
    of = cut.select("key", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.col("first").alias("at")), F.struct(F.lit(2).alias("cut"), F.col("second").alias("at")))).alias("c")).filter("c.at > 0")
    last = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(c.at - 1) div {block}")), lambda k: F.least(F.col("c.at"), (k + 1) * block) - 1))
    requests = of.select("key", "c.cut", last.alias("unit")).withColumn("block", F.expr(f"unit div {block}")).distinct()
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.length)
    units = cut.select("key", "second", F.posexplode(lengths).alias("unit", "chars")).filter("unit < second")
    units = units.select("key", F.col("unit").cast("long").alias("unit"), F.col("chars").cast("long").alias("chars")).dropDuplicates(["key", "unit"])
    along = Window.partitionBy("key", "block").orderBy("unit")
    sums = units.withColumn("block", F.expr(f"unit div {block}")).withColumn("end", F.sum("chars").over(along))
    found = requests.join(sums.select("key", "block", "unit", "end"), ["key", "block", "unit"])
    return found.groupBy("key").agg(F.sum(F.when(F.col("cut") == 1, F.col("end"))).alias("first_end"), F.sum(F.when(F.col("cut") == 2, F.col("end"))).alias("second_end"))


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> DataFrame:
    """Cut every text of ``docs`` (doc_id, text and others) at two units' ends and put its middle last.

    Returns one row per row: row (the input row as a struct), doc_id, n (units), form (plain, psm or spm), prefix_chars
    and middle_chars (null if plain) and output. A null text counts as empty, and empty texts stay plain; so do texts
    that contain one of the marks. Cuts are drawn from doc_id, a null one counting as ''; rows with one doc_id are cut
    by the same draws, each in its own text, and repeated rows alike. Both cuts may fall on one place: the middle is
    then empty. Texts are cut whole, however long. Input columns may have any names: they are read from ``row``. An
    empty table gives an empty result.
    """
    plan = plan_cuts(docs, seed, rate, spm)
    # A row for each document that is cut: the offsets are hashed, the texts only stream by.
    placed = plan.select("row", "doc_id", "text", "key", "n", "form").join(cut_offsets(plan, block).hint("shuffle_hash"), "key", "left")
    start, end = F.coalesce("first_end", F.lit(0)), F.coalesce("second_end", F.lit(0))
    text = F.col("text")
    prefix, middle, suffix = _between(text, F.lit(0), start), _between(text, start, end), _between(text, end)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_cut = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(text)
    return placed.select("row", "doc_id", "n", "form", F.when(is_cut, start).alias("prefix_chars"), F.when(is_cut, end - start).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part has a mark, so the first occurrence of each is the one set."""
    size, m = F.lit(len(PREFIX)), F.instr(output, MIDDLE) - 1
    middle = _between(output, m + size)
    at = F.when(form == "psm", F.instr(output, SUFFIX) - 1).otherwise(F.instr(output, PREFIX) - 1)
    head, tail = _between(output, size, at), _between(output, at + size, m)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


INFILL_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM base),
cut AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
