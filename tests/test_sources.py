import json

from pyspark.sql import functions as F

from quillstone.sources import bibliography as b
from quillstone.sources import sinks
from quillstone.streaming import ledger


def test_export(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('﻿EID,Title,Year,References\n2-s2.0-1, One ,2019,"a;\nb"\n,Two,n/a,\n', encoding="utf-8")
    rows = sorted(b.export(spark, str(p)).collect(), key=lambda r: r.title)
    assert (rows[0].eid, rows[0].title, rows[0].year, rows[0].references_raw) == ("2-s2.0-1", "One", 2019, "a;\nb")
    assert rows[1].eid.startswith("doc_") and rows[1].year is None


def test_uploaded(spark):
    df = spark.createDataFrame([("a ref", "10.1/x", "T"), ("", "10.2/y", "U"), (None, None, None)], "Citation string, DOI string, Title string")
    assert sorted(r.raw_reference for r in b.uploaded(df).collect()) == ["U. DOI: 10.2/y", "a ref"]


def test_checkpoint_rows(spark):
    df = spark.createDataFrame([(json.dumps({"reference_id": "a", "final_status": "ODD", "composite_score": 0.5}),), ("{broken",)], "result_json string")
    good, bad = b.checkpoint_rows(df)
    assert [(r.reference_id, r.final_status) for r in good.collect()] == [("a", "UNVERIFIED")]
    assert bad.count() == 1


def test_registry_records(spark):
    c = json.dumps({"DOI": "10.1/x", "title": ["T"], "author": [{"family": "Doe", "given": "A"}], "created": {"date-parts": [[2001, 2]]}, "update-to": [{"type": "retraction"}]})
    r = spark.range(1).select(b.crossref(F.lit(c))).first()[0]
    assert (r.doi, r.title, r.authors, r.year, r.is_retracted) == ("10.1/x", "T", "Doe, A", 2001, True)
    o = json.dumps({"doi": "https://doi.org/10.2/y", "biblio": {"first_page": "5"}, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}})
    r = spark.range(1).select(b.openalex(F.lit(o)), b.inverted_abstract(F.lit(o))).first()
    assert (r[0].doi, r[0].pages, r[1]) == ("10.2/y", "5", "hello world hello")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], True, "AMBIGUOUS")], "id string, tags array<string>, needs_human_review boolean, final_status string")
    assert sinks.write_csv(df, str(tmp_path / "o"), 1) and not sinks.write_csv(df.filter("false"), str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).first().tags == "x; y"
    assert sinks.write_sheets(sinks.sheets(df, df, df.agg(F.count("*").alias("total"))), str(tmp_path / "w")) == ["Summary", "Documents", "All_References", "Human_Review"]


def test_incremental_and_fold(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "QUEUED"), (2, "a", "RUNNING"), (3, "b", "QUEUED"), (4, "b", "DONE")], "event_id long, run string, state string").write.parquet(src)
    schema = "event_id long, run string, state string"
    for _ in range(2):
        ledger.incremental(ledger.events(spark, src, schema), ledger.upsert_batch(str(tmp_path / "out"), "event_id"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    folded = ledger.fold(ledger.events(spark, src, schema), "run", "state", "event_id", {"QUEUED": {"RUNNING"}, "RUNNING": {"DONE"}})
    q = folded.writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.run, r.state, r.moves, r.illegal) for r in spark.table("folded").collect()) == [("a", "RUNNING", 1, 0), ("b", "QUEUED", 0, 1)]
