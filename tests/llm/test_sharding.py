import zlib
from collections import Counter

from quillstone.llm import sharding
from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_law_slots_and_mixture(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_shard_documents"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.text_crc32 == zlib.crc32((docs[r.doc_id].text or "").encode()) and r.size == len((docs[r.doc_id].text or "").encode()) + 1 for r in rows)
    sources = Counter(d.source for d in docs.values())
    for s in counts:
        here = Counter(docs[r.doc_id].source for r in rows if r.shard == s)
        assert all(abs(here[k] - n / 8) <= 2 for k, n in sources.items())


def test_odd_rows(odd, none):
    got = sharding.shard(odd, shards=3).collect()
    assert len(got) == 10 and sorted(Counter(r.shard for r in got).values()) == [3, 3, 4]
    assert sharding.shard(none).count() == 0
    assert sorted((str(r.row), r.shard, r.slot) for r in got) == sorted((str(r.row), r.shard, r.slot) for r in sharding.shard(odd.repartition(5), shards=3).collect())


def test_many_sources_of_one_row(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', id) as source")
    assert all(abs(n - 50) <= 1 for n in Counter(r.shard for r in sharding.shard(docs).collect()).values())
