"""Exact rounding, people's names, merged references, leases and associations against plain Python."""

import random

from pyspark.sql import functions as F

from quillstone.functions import artifacts, citations, fuzzy, numbers, people, rules
from quillstone.operators import clustering, jobs, matching


def _each(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_exact_round_is_pythons(spark):
    rng = random.Random(5)
    xs = [2.675, 0.125, 0.375, -0.125, -2.675, 1.005, 0.5, 1.5, 2.5, 0.0, 1e15, 123456789.125]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [rng.randrange(-4000, 4000) / 16 for _ in range(1000)] + [rng.randrange(1, 100000) / 1000 + 0.0005 for _ in range(1000)]
    for places in (1, 2, 3, 4):
        assert _each(spark, xs, "double", lambda c, p=places: numbers.exact_round(c, p)) == [round(x, places) for x in xs]
    odd = _each(spark, [None, float("inf"), 1e300], "double", lambda c: numbers.exact_round(c, 2))
    assert odd == [None, float("inf"), 1e300]


def test_people(spark):
    got = _each(spark, [["Ann B. Lee", None, "Ann Lee", "Ann C. Lee", "", "ann b lee", "Bo", "Bo", "Bo Lee", "--", "é"], [], None], "array<string>", people.distinct_people)
    assert got == [["Ann B. Lee", "Ann C. Lee", "Bo", "Bo Lee", "--"], [], None]
    names = ["Z. Guo", "W.-t. Yih", "Guo, Z.", "Guo Z.", "Farrington", "World Health Bodies", "Smith et al.", "A. van Dam"]
    others = ["a study of many things", "On the origin of such things", "", None, "x" * 61, "lower", " . "]
    assert _each(spark, names + others, "string", people.reads_as_author) == [True, True, False, True, True, True, True, True] + [False] * len(others)


def test_unmerged_references(spark):
    two = "[1] Some work of the first. [ 1 2 ] Another work that follows."
    dotted = "1. Some work of the first. 2. Another work that follows."
    got = _each(spark, [two, dotted, "[1] Only one reference here", "[1] Short [2] Also short one, not it", None, ""], "string", citations.unmerged)
    assert got[0] == ["[1] Some work of the first.", "[12] Another work that follows."]
    assert got[1] == ["1. Some work of the first.", "2. Another work that follows."]
    assert got[2:] == [["[1] Only one reference here"], ["[2] Also short one, not it"], [], []]


def test_staging(spark):
    df = spark.createDataFrame([(".git", None), (".GIT/x", False), (".gitignore", False), ("a/.git/x", True), ("credentials", True), (None, None)], "p string, s boolean")
    assert [r.f for r in df.select(artifacts.staging_fault(F.col("p"), F.col("s")).alias("f")).collect()] == ["INVALID_TARGET", "INVALID_TARGET", None, "ARTIFACT_CHANGED", "INVALID_TARGET", None]


def test_verification(spark):
    df = spark.createDataFrame([("AI_ML", []), ("AI_ML", ["BLOCKED", "PARTIALLY_READY"]), ("AI_ML", ["BLOCKED"]), ("AI_ML", ["BLOCKED", "UNKNOWN"]), (None, []), ("SOCIAL_SCIENCE", [])], "d string, p array<string>")
    got = df.select(rules.verification_status(F.col("d"), F.col("p"), F.lit(None).cast("boolean")).alias("s"), rules.verification_methods(F.col("d")).alias("m")).collect()
    assert [r.s for r in got] == ["INSUFFICIENT_EVIDENCE", "PARTIALLY_VERIFIABLE", "INACCESSIBLE", "INSUFFICIENT_EVIDENCE", "UNKNOWN", "REQUIRES_HUMAN_VALIDATION"]
    assert got[4].m == ["UNKNOWN"] and got[0].m == ["COMPUTATIONAL_REPRODUCTION"]


def test_jobs(spark):
    runs = spark.createDataFrame([(1, "QUEUED"), (2, "RUNNING"), (3, "QUEUED")], "run_id int, status string")
    asked = spark.sql("SELECT * FROM VALUES (1, 'b', DATE'2020-01-01'), (1, 'a', DATE'2020-01-01'), (1, 'c', DATE'2020-01-02'), (2, 'a', DATE'2020-01-01') AS t(run_id, worker_id, at)")
    beats = spark.sql("SELECT * FROM VALUES (1, 'a', DATE'2020-01-05'), (1, 'b', DATE'2020-01-09'), (2, 'a', DATE'2020-01-09') AS t(run_id, worker_id, at)")
    got = {r.run_id: r for r in jobs.beaten(jobs.claimed(runs, asked, "INTERVAL 1 DAY"), beats, "INTERVAL 1 DAY").collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["CLAIMED", "RUNNING", "QUEUED"]
    assert got[1].worker_id == "a" and str(got[1].heartbeat_at)[:10] == "2020-01-05" and str(got[1].lease_expiry)[:10] == "2020-01-06" and got[2].worker_id is None
    stopped = jobs.cancel(runs.union(spark.createDataFrame([(4, "FAILED"), (5, "CANCELLED")], runs.schema)), spark.createDataFrame([(1,), (1,), (4,), (5,), (9,)], "run_id int"))
    assert sorted(tuple(r) for r in stopped.collect()) == [(1, "REQUESTED", "CANCEL_REQUESTED"), (4, "REFUSED", "FAILED"), (5, "UNCHANGED", "CANCELLED"), (9, "UNKNOWN_RUN", None)]


def test_associated(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["cola", "coal", "squad", "glue", "mnist", "bert", "ab", "x"])
    contexts = [(p, " ".join(word() for _ in range(rng.randrange(1, 5)))) for p in range(4) for _ in range(8)]
    experiments = [(p, f"e{i}", i, f"{word()} {word()}", rng.choice([None, word()])) for p in range(3) for i in range(4)]
    out = matching.associated(spark.createDataFrame(contexts, "p int, text string"), spark.createDataFrame(experiments, "p int, e string, at int, d string, m string"), "p", "text", "e", "at", ["d", "m"])

    def best(paper, text):
        scored = [(max([fuzzy.token_set(t, text) for t in (d, m) if t and len(t) >= 3], default=0.0), -at, e) for p, e, at, d, m in experiments if p == paper]
        return max(scored)[2] if scored and max(scored)[0] >= 80 else None

    assert sorted((r.p, r.text, r.e or "") for r in out.collect()) == sorted((p, t, best(p, t) or "") for p, t in contexts)


def test_listed_references(spark):
    keys = "Before [Ab01] one\n[Cd02a] two [E+03]  three\n\n[Fg04] \n[Hi05] five, x[No06] not"
    few = "[Ab01] one of them only, not five"
    mixed = "[1] The first numbered work here.\n[2] The second numbered work here.\n"
    got = _each(spark, [keys, few, mixed, None, ""], "string", citations.listed_references)
    assert got[0] == ["[Ab01] one", "[Cd02a] two", "[E+03]  three", "[Fg04]", "[Hi05] five, x[No06] not"]
    assert got[1:] == [[few], ["[1] The first numbered work here.", "[2] The second numbered work here."], [], []]


def test_experiment_clusters(spark):
    names = ["objective", *clustering.MERGED]
    rows = [  # paper, at, objective, dataset, split, model, metric, baseline, reported_result
        (1, 0, "Train the small net", "A", None, None, "acc", None, None),
        (1, 1, "Train the small net!", "a", "test", "M", None, None, "0.9"),
        (1, 2, "train the small net", "A", None, "N", None, None, None),
        (1, 3, "Train the small net", None, None, None, None, None, None),
        (1, 4, "Train the small net", None, None, None, None, None, None),
        (1, 5, "Train with 10 images per class", "A", None, None, None, None, None),
        (1, 6, "Train with 50 images / class", "A", None, None, None, None, None),
        (1, 7, "Train the small net", "A", None, None, "acc", None, None),
        (2, 0, None, "A", None, None, None, "base", None),
        (2, 1, "", "A", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "paper int, at int, " + ", ".join(f"{n} string" for n in names))
    got = {(r.paper, r.cluster): r for r in clustering.experiment_clusters(df, "paper", "at").collect()}
    assert {k: r.n for k, r in got.items()} == {(1, 0): 3, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): 1, (2, 0): 2}
    first = got[1, 0]
    assert (first.objective, first.dataset, first.split, first.model, first.metric, first.reported_result) == ("Train the small net!", "A", "test", "M", "acc", "0.9")
    assert got[2, 0].baseline == "base" and clustering.experiment_clusters(df.limit(0), "paper", "at").count() == 0
