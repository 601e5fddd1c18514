"""Tables published at once, resumed runs, leases with timers, JSON in answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions.model_json import tolerant_json
from quillstone.operators import publishing as p
from quillstone.streaming import ledger


def test_a_version_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    folder, of = f"file://{tmp_path}/t", lambda n: spark.range(n)
    assert p.publish(spark, folder, {"a": of(1), "b": of(2)}) == 1
    failing = spark.range(5).select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        p.publish(spark, folder, {"a": of(10), "b": failing})
    assert [p.read(spark, folder, n).count() for n in "ab"] == [1, 2] and p.versions(spark, folder) == [1]
    assert p.publish(spark, folder, {"a": of(10)}, after=1) == 2
    assert [p.read(spark, folder, n).count() for n in "ab"] == [10, 2]
    assert [p.read(spark, folder, n, version=1).count() for n in "ab"] == [1, 2]
    with pytest.raises(p.Conflict):
        p.publish(spark, folder, {"a": of(3)}, after=1)
    with pytest.raises(FileNotFoundError):
        p.read(spark, folder, "a", version=9)


def test_two_writers(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    seen = p.versions
    monkeypatch.setattr(p, "versions", lambda *a: [])  # what both saw before either had published
    assert p.publish(spark, folder, {"a": spark.range(1)}) == 1
    with pytest.raises(p.Conflict):
        p.publish(spark, folder, {"a": spark.range(2)})
    monkeypatch.setattr(p, "versions", seen)
    assert p.read(spark, folder, "a").count() == 1


def events(spark, folder, *files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "run string, at timestamp").coalesce(1).write.parquet(f"{folder}/part={k}")


def test_a_stopped_run_is_resumed(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id long"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def fragile(df):
        calls.append(df.count())
        return df.select(F.when((F.col("id") % 10 == 7) & F.lit(len(calls) == 3), F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))

    with pytest.raises(Exception, match="lost"):
        ledger.resumable(stream(), fragile, f"{tmp_path}/run")
    half = ledger.done(spark, f"{tmp_path}/run/rows", schema)
    assert half.filter("epoch < 2").count() == 20
    ledger.resumable(stream(), fragile, f"{tmp_path}/run")
    whole = ledger.done(spark, f"{tmp_path}/run/rows", schema)
    assert sorted(r.id for r in whole.collect()) == list(range(40)) and whole.select("epoch").distinct().count() == 4
    ledger.resumable(stream(), fragile, f"{tmp_path}/run")
    assert ledger.done(spark, f"{tmp_path}/run/rows", schema).count() == 40 and len(calls) == 5
    assert ledger.done(spark, f"{tmp_path}/none", schema).count() == 0


def test_leases_over_batches(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=s)
    events(spark, f"{tmp_path}/in", [("a", t(0)), ("b", t(5))], [("a", t(40)), ("a", t(20))], [("a", t(200)), ("c", t(300))], [("c", t(330))], [("d", t(5000))], [("d", t(5001))])
    stream = spark.readStream.schema("run string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = ledger.lease_events(stream, "at", "run", 60, "30 seconds")
    got = sorted((r.run, r.at, r.event) for r in ledger.run_once(out, "append").collect())
    want = [
        ("a", 0, "CLAIMED"), ("a", 20, "RENEWED"), ("a", 40, "RENEWED"), ("a", 100, "EXPIRED"), ("a", 200, "CLAIMED"), ("a", 260, "EXPIRED"), ("b", 5, "CLAIMED"), ("b", 65, "EXPIRED"),
        ("c", 300, "CLAIMED"), ("c", 330, "RENEWED"), ("c", 390, "EXPIRED"), ("d", 5000, "CLAIMED"), ("d", 5001, "RENEWED"),
    ]
    assert got == sorted((k, t(s), e) for k, s, e in want)


@pytest.mark.parametrize(("answer", "value"), [
    ('{"a": 1}', {"a": 1}), (' \n[1, 2]\n', [1, 2]), ('Sure:\n```json\n{"a": "x"}\n```\nbye {', {"a": "x"}), ('```\n{"a": 2}```', {"a": 2}), ('so {"a": "} {", "b": {"c": "\\"}"}} and {"d": 1}', {"a": "} {", "b": {"c": '"}'}}),
    ('```json\n{broken\n```\nbut {"a": 3}', None), ('first {"a": 4}} then', {"a": 4}), ("{never closed", None), ("no json", None), ("", None), (None, None), ("﻿{\"a\": 5}", {"a": 5}), ('it is {"a": "' + "x\\n" * 5000 + '"} ok', {"a": "x\n" * 5000}),
])
def test_json_in_answers(spark, answer, value):
    got = spark.createDataFrame([(answer,)], "t string").select(F.to_json(tolerant_json(F.col("t"))).alias("j")).first().j
    assert (None if got is None else json.loads(got)) == value
