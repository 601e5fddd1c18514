"""The operators applied to their whole tables, by name, and the SQL that some are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat, collocations, decontaminate, html_extract, infill, line_dedup, minhash, mixing, pii, quality_fm, quality_rules, sharding, substring


def table(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{which}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shard(docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")))
    return dealt.select("doc_id", (F.col("row.size") + 1).alias("size"), "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _count(kind: str, base: bool = False) -> Column:
    of_kind = lambda s: (s["base"] if base else F.lit(True)) & (s["kind"] == kind)
    return F.size(F.filter("spans", of_kind)).cast("long").alias(f"n_{kind}")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    number = [*[_count(kind, base=True) for kind in pii.KINDS], F.size("spans").cast("long").alias("n_spans"), *[_count(kind) for kind in pii.EXTRA]]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *number, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and what is left of it."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the verdict of the n-gram classifier for every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factorisation machine's score of every document."""
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items found in documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that earlier 20-word windows cover, and what is left."""
    return substring.find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cuts of every document, its output and the text read back from that."""
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say, read back from their texts, tokens and masks."""
    return chat.chat_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language."""
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_documents": op2_shard_documents,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_quality_fm": op7_quality_fm,
    "op8_html_extract": op8_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_format": op12_chat_format,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.MIX_SQL,
    "op2_shard_documents": sharding.SHARD_SQL,
    "op4_line_dedup": line_dedup.LINES_SQL,
    "op11_fill_in_middle": infill.INFILL_SQL,
    "op12_chat_format": chat.CHAT_SQL,
    "op13_phrases": collocations.PHRASES_SQL,
}
