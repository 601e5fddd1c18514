import hashlib
import json

from pyspark.sql import functions as F

from quillstone.functions import canonical, citations
from quillstone.operators.clustering import claim_clusters


def test_hash_is_that_of_sorted_compact_json(spark):
    df = spark.createDataFrame([({"z": 1, "a": None}, {"k2": "v", "k1": "w"}, [{"y": 1, "x": "é"}], "later")], "s struct<z: int, a: string>, m map<string,string>, l array<struct<y: int, x: string>>, generated_at string")
    got = df.select(canonical.content_hash(F.struct("*"), df.schema)).first()[0]
    want = {"s": {"z": 1, "a": None}, "m": {"k1": "w", "k2": "v"}, "l": [{"y": 1, "x": "é"}]}
    assert got == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_manifest_hash_ignores_order(spark):
    a, b = F.struct(F.lit("a").alias("path"), F.lit("1").alias("sha256")), F.struct(F.lit("b").alias("path"), F.lit("2").alias("sha256"))
    r = spark.range(1).select(canonical.manifest_hash(F.array(a, b)), canonical.manifest_hash(F.array(b, a)), canonical.manifest_hash(F.array(a))).first()
    assert r[0] == r[1] != r[2]


def test_clusters(spark):
    rows = [("p", 1, "The model reaches an accuracy of 0.81 on the held-out test set."), ("p", 2, "the model  reaches an accuracy of 0.81 on the held-out test set."), ("p", 3, "The model reaches an accuracy of 0.81 on the held-out test sets."), ("p", 4, "Another claim."), ("q", 5, "Another claim.")]
    got = {r.n: r.cluster for r in claim_clusters(spark.createDataFrame(rows, "paper string, n int, t string"), ["paper"], "n", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_author_date_bibliography(spark):
    raw = "Smith, J., Doe, A. (2001). A first work of note. Journal of Things. Roe, B. (2002). A second work of note. Press house. Poe, E. A. (1845). The raven and more. Evening Mirror."
    assert len(spark.range(1).select(citations.split_bibliography(F.lit(raw))).first()[0]) == 3
