import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing
from quillstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by dealing the excess out again until no source is above its cap. sizes: in source order."""
    total, w = share * sum(sizes), [weights[i % 3] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        rest, free = total - sum(cap * sizes[i] for i in full), sum(w[i] for i in range(len(sizes)) if i not in full)
        target = [float(cap * s) if i in full else rest * w[i] / free for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in full and target[i] > cap * s}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [[100], [10, 10, 10], [1000, 10, 10, 10], [5, 500, 7, 3000, 0, 2], [1, 1, 1, 1000, 1000, 1000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(False, f"s{i:02}", s) for i, s in enumerate(sizes)], "src_null boolean, src string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("src").collect()]
    assert got == pytest.approx(by_hand(sizes))


def test_words_taken_come_near_the_targets(spark):
    out = QUERIES["op1_mix_sources"](spark, SF)
    per = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert all(abs(r.taken - r.target) <= 0.15 * r.target + r.most for r in per.collect())
    assert out.filter("taken > 2 * size or copies not between 0 and 2").count() == 0


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_shard_documents", "op4_line_dedup"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    flat = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert flat(out.select(*columns).collect()) == flat(want)


def test_odd_rows(odd, none):
    plan = mixing.plan_mix(odd)
    assert plan.count() == 10
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns
    assert plan.filter("source is null and doc_id = 5").select("source_size").distinct().count() == 1
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
