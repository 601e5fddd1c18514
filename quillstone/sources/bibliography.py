"""Bibliographic exports, uploads, checkpoints and registry records as DataFrames (SRC01-SRC27, PRJ04-PRJ12)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which uploads carry a reference, an identifier and a title.
REFERENCE_NAMES = ("reference", "citation", "raw_reference", "ref", "text", "raw reference")
DOI_NAMES = ("doi", "extracted_doi", "normalized_doi")
TITLE_NAMES = ("title", "cited_title", "article_title")
EXPORT_COLUMNS = ("EID", "Title", "Year", "Source title", "DOI", "Link", "Authors", "Author full names", "Author(s) ID", "References")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quoted line breaks and an optional byte order mark, all columns as text."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def export(spark: SparkSession, path: str) -> DataFrame:
    """An abstract index's export: one row for each document; needs Title and EID, absent columns are ''.

    A blank EID becomes ``doc_`` and the row's number: a file with quoted line breaks is one partition, so
    numbers follow the file; over several files they are unique but not gapless.
    """
    df = read_csv(spark, path)
    missing = {"Title", "EID"} - set(df.columns)
    if missing:
        raise ValueError(f"the export lacks {', '.join(sorted(missing))}")
    c = lambda name: F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in df.columns else F.lit("")
    numbered = df.withColumn("__row", F.monotonically_increasing_id() + 1)
    out = {"title": "Title", "source_title": "Source title", "doi": "DOI", "link": "Link", "authors": "Authors", "author_full_names": "Author full names", "author_ids": "Author(s) ID", "references_raw": "References"}
    eid = F.when(c("EID") != "", c("EID")).otherwise(F.concat(F.lit("doc_"), F.col("__row").cast("string")))
    year = F.when(c("Year").rlike("^[0-9]+$"), c("Year").try_cast("int"))
    return numbered.select(eid.alias("eid"), year.alias("year"), *[c(v).alias(k) for k, v in out.items()])


def alias(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The first column that goes by one of the names, regardless of case."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[n] for n in names if n in known), None)


def uploaded(df: DataFrame, first_is_reference: bool = False) -> DataFrame:
    """References of an upload with one in a row: reference_no, raw_reference, doi, title. Blank rows go.

    A row without a reference is built of its title and identifier. ``None`` as text is nothing.
    """
    ref, doi, title = (alias(df.columns, n) for n in (REFERENCE_NAMES, DOI_NAMES, TITLE_NAMES))
    if ref is None and first_is_reference:
        ref = df.columns[0]
    clean = lambda c: F.nullif(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")), F.lit("None")) if c else F.lit(None).cast("string")
    r, d, t = clean(ref), clean(doi), clean(title)
    built = F.when(t.isNotNull() & d.isNotNull(), F.concat(t, F.lit(". DOI: "), d)).otherwise(t)
    out = df.select((F.monotonically_increasing_id() + 1).alias("reference_no"), F.coalesce(r, built).alias("raw_reference"), F.coalesce(d, F.lit("")).alias("doi"), F.coalesce(t, F.lit("")).alias("title"))
    return out.filter("raw_reference is not null")


def lenient_int(text: Column) -> Column:
    return F.floor(text.try_cast("double")).try_cast("int")


def lenient_bool(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("true", "1", "t", "yes")


RESULT = T.StructType([
    T.StructField("reference_id", T.StringType()), T.StructField("source_eid", T.StringType()), T.StructField("raw_reference", T.StringType()), T.StructField("final_status", T.StringType()),
    T.StructField("confidence", T.StringType()), T.StructField("composite_score", T.DoubleType()), T.StructField("normalized_doi", T.StringType()), T.StructField("needs_human_review", T.BooleanType()),
    T.StructField("http_status", T.IntegerType()), T.StructField("cited_year", T.IntegerType()), T.StructField("_corrupt_record", T.StringType()),
])
#: Statuses of a verified reference.
STATUSES = (
    "VALID_CORRECT", "VALID_REDIRECT_CORRECT", "VALID_DOI_WRONG_REFERENCE", "METADATA_MISMATCH", "ACCESS_RESTRICTED", "BROKEN_URL", "INVALID_DOI", "DOI_MISSING", "DOI_RECOVERED",
    "DOI_RECOVERY_UNCERTAIN", "RETRACTED_REFERENCE", "AMBIGUOUS", "WORK_FOUND_NO_DOI", "SCOPUS_LINKED_NO_DOI", "SCOPUS_UNLINKED", "UNVERIFIED",
)


def checkpoint_rows(df: DataFrame, payload: str = "result_json") -> tuple[DataFrame, DataFrame]:
    """Typed rows of a checkpoint's JSON, and the rows that cannot be read. Unknown statuses are UNVERIFIED."""
    parsed = df.withColumn("r", F.from_json(payload, RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select("r.*").drop("_corrupt_record")
    known = F.when(F.col("final_status").isin(list(STATUSES)), F.col("final_status")).otherwise("UNVERIFIED")
    return good.withColumn("final_status", known), parsed.filter(bad).drop("r")


CROSSREF = "struct<DOI: string, title: array<string>, `container-title`: array<string>, author: array<struct<family: string, given: string>>, volume: string, issue: string, page: string, `published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>, created: struct<`date-parts`: array<array<int>>>, `update-to`: array<struct<type: string>>>"


def crossref(payload: Column) -> Column:
    """Canonical metadata of one registry record's JSON."""
    r = F.from_json(payload, CROSSREF)
    year = lambda f: F.get(F.get(r[f]["date-parts"], F.lit(0)), F.lit(0))
    names = F.transform(r["author"], lambda a: F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit(""))))
    return F.struct(
        F.coalesce(r["DOI"], F.lit("")).alias("doi"), F.coalesce(F.get(r["title"], F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.array_join(names, "; "), F.lit("")).alias("authors"),
        F.coalesce(F.get(r["container-title"], F.lit(0)), F.lit("")).alias("journal"), F.coalesce(year("published-print"), year("published-online"), year("created")).alias("year"),
        F.coalesce(r["volume"], F.lit("")).alias("volume"), F.coalesce(r["issue"], F.lit("")).alias("issue"), F.coalesce(r["page"], F.lit("")).alias("pages"),
        F.coalesce(F.exists(r["update-to"], lambda u: u["type"].isin("retraction", "removal")), F.lit(False)).alias("is_retracted"), F.lit("crossref").alias("provider"),
    )


OPENALEX = "struct<doi: string, title: string, authorships: array<struct<author: struct<display_name: string>>>, primary_location: struct<source: struct<display_name: string>>, publication_year: int, biblio: struct<volume: string, issue: string, first_page: string, last_page: string>, is_retracted: boolean, abstract_inverted_index: map<string, array<int>>>"


def openalex(payload: Column) -> Column:
    """Canonical metadata of one open catalogue record's JSON."""
    r = F.from_json(payload, OPENALEX)
    pages = F.regexp_replace(F.concat(F.coalesce(r["biblio"]["first_page"], F.lit("")), F.lit("-"), F.coalesce(r["biblio"]["last_page"], F.lit(""))), "^-|-$", "")
    return F.struct(
        F.coalesce(F.regexp_replace(r["doi"], "(?i)^https?://doi.org/", ""), F.lit("")).alias("doi"), F.coalesce(r["title"], F.lit("")).alias("title"),
        F.coalesce(F.array_join(F.transform(r["authorships"], lambda a: a["author"]["display_name"]), "; "), F.lit("")).alias("authors"), F.coalesce(r["primary_location"]["source"]["display_name"], F.lit("")).alias("journal"),
        r["publication_year"].alias("year"), F.coalesce(r["biblio"]["volume"], F.lit("")).alias("volume"), F.coalesce(r["biblio"]["issue"], F.lit("")).alias("issue"), pages.alias("pages"),
        F.coalesce(r["is_retracted"], F.lit(False)).alias("is_retracted"), F.lit("openalex").alias("provider"),
    )


def inverted_abstract(payload: Column, most: int = 6000) -> Column:
    """The text of an abstract kept as positions by word."""
    index = F.from_json(payload, OPENALEX)["abstract_inverted_index"]
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "), 1, most)


def clean_abstract(text: Column, most: int = 6000) -> Column:
    """Tags away, common entities decoded, white space squeezed, cut."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def filled(first: Column, *others: Column) -> Column:
    """The first text that is neither empty nor '{}'."""
    return F.coalesce(*[F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("{}")) for c in (first, *others)], F.lit(""))


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys with what a provider's table knows of them; each distinct key is looked up once."""
    return keys.join(table, key, "left")


def missing(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys, lower-cased and trimmed, that a cache does not have yet."""
    asked = keys.select(F.lower(F.trim(key)).alias("cache_key")).distinct()
    return asked.join(cache.select("cache_key"), "cache_key", "left_anti")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with the route that their name gives them."""
    files = spark.read.format("binaryFile").load(path)
    n = F.lower("path")
    route = F.when(n.rlike(r"\.(pdf|docx?|txt|md)$"), "MANUSCRIPT").when(n.endswith(".csv"), "CSV").when(n.rlike(r"\.xlsx?$"), "WORKBOOK").otherwise("NONE")
    return files.select("path", "length", "content", route.alias("route"))
