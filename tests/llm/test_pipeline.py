from collections import Counter

import corpus_pipeline
from test_minhash import brute

from quillstone.llm import quality_fm

SF = "/root/testdata/sf0.001"


def test_against_plain_versions_of_the_stages(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    score = {r.doc_id: r.score for r in quality_fm.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = [r for r in docs.collect() if score[r.doc_id] >= quality_fm.THRESHOLD]
    group = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if group[r.doc_id][1] == r.doc_id]
    items = [r.text for r in bench.collect()]
    rows = [r for r in rows if not any(t in r.text or t.upper() in r.text for t in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in rows}
    times = Counter(r.doc_id for r in got)
    assert max(times.values()) <= 2
    words = {r.doc_id: len(r.text.encode().split()) for r in rows}
    assert abs(sum(words[d] * n for d, n in times.items()) - 1.5 * sum(words.values())) < 0.1 * sum(words.values()) + max(words.values())
    assert {r.text for r in got} <= {r.text for r in rows}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        if name != "shards":
            assert out.columns == docs.columns
