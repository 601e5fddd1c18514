"""Uploads of several formats as one table of references (SRC02-SRC04, SRC09).

A file's route follows from its name. Texts are cut to their bibliographies; tables with a column of whole bibliographies
are split, and tables with a reference in a row are read by the names that their columns go by. Only the cells of a CSV
file are found in Python, one file at a time in Arrow batches, as quotes may hold line ends; all rules are expressions.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.bibliographies import manuscript_references
from quillstone.functions.citations import manuscript_parts, split_references
from quillstone.sources.bibliography import DOI_NAMES, REFERENCE_NAMES, TITLE_NAMES

#: Rows of cells in a batch, about.
ROWS = 2000
CELLS = "path string, row_no long, cells map<string, string>"
CELLS_ARROW = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])


def route(path: Column) -> Column:
    """What kind of upload a name says a file is."""
    n = F.lower(path)
    return F.when(n.rlike(r"\.(txt|md)$"), "TEXT").when(n.endswith(".csv"), "CSV").when(n.rlike(r"\.(pdf|docx?|xlsx?)$"), "UNREAD").otherwise("NONE")


def decoded(content: Column) -> Column:
    """Bytes as text: a mark of byte order goes, bad bytes are replaced."""
    return F.regexp_replace(F.decode(content, "UTF-8"), r"\A﻿", "")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = csv.reader(io.StringIO(text or "", newline=""))
            names = [n.lower().strip() for n in next(reader, [])]
            for number, row in enumerate((r for r in reader if r), 1):
                # Of two columns with one name the last counts; a short row lacks its last cells.
                out.append((path, number, list(dict(zip(names, row, strict=False)).items())))
                if len(out) >= ROWS:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CELLS_ARROW, strict=True)], schema=CELLS_ARROW)


def csv_cells(files: DataFrame) -> DataFrame:
    """(path, row_no, cells): the rows below the first one, by the names in that in lower case."""
    return files.select("path", decoded(F.col("content")).alias("text")).mapInArrow(_cells, CELLS)


def _cell(names: tuple[str, ...] | list[str]) -> Column:
    """The cell of the first name that the table has, null for a blank one and for ``None``."""
    present = F.coalesce(*[F.when(F.map_contains_key("cells", n), F.coalesce(F.element_at("cells", n), F.lit(""))) for n in names])
    return F.nullif(F.nullif(F.trim(present), F.lit("")), F.lit("None"))


def references_of(files: DataFrame) -> DataFrame:
    """One row per reference of each file (path, content): path, route, source, reference_no, raw_reference, doi, title.

    Texts give the entries of their bibliography. A table with a column ``references`` gives, for each row, what that
    holds, with the row's ``eid`` or ``doc_n`` as ``source``; another one gives its rows with a reference, or a title
    and identifier, numbered as rows. Rows that say nothing go. Files that hold no text, and other formats, give none.
    """
    known = files.withColumn("route", route(F.col("path")))
    texts = known.filter("route = 'TEXT'").select("path", F.explode(F.array(decoded(F.col("content")))).alias("whole"))
    texts = texts.select("path", F.explode(F.array(manuscript_parts(F.col("whole"))["bibliography"])).alias("text"))
    empty = F.lit("")
    written = manuscript_references(texts.filter("text <> ''"), "path", "text").select("path", F.lit("TEXT").alias("route"), F.col("path").alias("source"), F.col("number").cast("long").alias("reference_no"), F.col("raw").alias("raw_reference"), empty.alias("doi"), empty.alias("title"))

    cells = csv_cells(known.filter("route = 'CSV'"))
    whole = F.map_contains_key("cells", "references")
    eid = F.coalesce(_cell(["eid"]), F.concat(F.lit("doc_"), F.col("row_no").cast("string")))
    exported = cells.filter(whole).select("path", eid.alias("source"), F.posexplode(split_references(F.element_at("cells", "references"))).alias("pos", "r"))
    exported = exported.select("path", F.lit("EXPORT").alias("route"), "source", (F.col("pos") + 1).cast("long").alias("reference_no"), F.col("r.raw").alias("raw_reference"), empty.alias("doi"), empty.alias("title"))

    reference, doi, title = (_cell(n) for n in (REFERENCE_NAMES, DOI_NAMES, TITLE_NAMES))
    raw = F.coalesce(reference, F.when(title.isNotNull() & doi.isNotNull(), F.concat(title, F.lit(". DOI: "), doi)).otherwise(title))
    listed = cells.filter(~whole).select("path", F.lit("ROWS").alias("route"), F.col("path").alias("source"), F.col("row_no").alias("reference_no"), raw.alias("raw_reference"), F.coalesce(doi, empty).alias("doi"), F.coalesce(title, empty).alias("title")).filter(F.col("raw_reference").isNotNull())
    return written.unionByName(exported).unionByName(listed)
