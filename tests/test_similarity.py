import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import fuzzy
from quillstone.operators import similarity as s

WORDS = "the nets reach high scores on both tasks while data of old kinds are few and models learn slowly from them in one case or another".split()


def some_texts(n, seed, low=3, high=14):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(low, high))) for _ in range(n)]


@given(st.lists(st.text(alphabet="ab c", max_size=12), max_size=8), st.lists(st.text(alphabet="ab c", max_size=12), max_size=8), st.sampled_from([0.5, 55.0, 80.0, 100.0]))
@settings(max_examples=300, deadline=None)
def test_no_pair_is_lost_by_the_bounds(a, b, least):
    want = {(i, j): fuzzy.token_set(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    assert {(i, j): v for i, j, v in s.score_block(a, b, least)} == {k: v for k, v in want.items() if v >= least}


def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 8)
    a = [(p, t) for p in (1, 2) for t in some_texts(30, p)] + [(1, None), (3, "alone here"), (1, " ")]
    b = [(p, t) for p in (1, 2) for t in some_texts(40, 10 + p)] + [(2, None), (4, "alone there")]
    left, right = spark.createDataFrame(a, "p int, claim_text string"), spark.createDataFrame(b, "p int, context string")
    got = {(r.p, r.claim_text, r.context): r.similarity for r in s.similar_texts(left, right, "p", "claim_text", "context").collect()}
    want = {(p, x, y): fuzzy.token_set(x, y) for p, x in a if x for q, y in b if q == p and y}
    assert got == {k: v for k, v in want.items() if v >= 55} and 50 < len(got) < len(want)


def test_references_of_claims(spark):
    claims = spark.createDataFrame([("k", "C1", "nets reach high scores"), ("k", "C2", "nothing like it zzz qqq"), ("k", "C3", "old data are few")], "p string, claim_id string, claim_text string")
    rows = [
        ("k", 0, 0, [1, 2], "[1, 2]", None, None, None, "It is shown that nets reach high scores [1, 2]"), ("k", 1, 1, [], "(Lee, 2020)", "Lee, 2020", None, None, "nets reach high scores (Lee, 2020)"),
        ("k", 2, 2, [9], "[9]", None, None, None, "old data are few [9]"), ("k", 3, 3, [2], "[2]", None, None, None, "It is shown that nets reach high scores [1, 2]"), ("k", 4, 4, [], "Ray et al. (1999)", None, "Ray et al.", "1999", "old data are few says Ray"), ("k", 5, 5, [1], "[1]", None, None, None, None),
    ]
    citations = spark.createDataFrame(rows, "p string, citation_id int, place int, keys array<long>, marker string, content string, author string, year string, context string")
    references = spark.createDataFrame([("k", "R1", 1, ["A. Fox"], 2001), ("k", "R2", 2, ["B. Dee"], None), ("k", "R3", 3, ["Bo Ray", "Ann Lee"], 2020), ("k", "R4", 4, ["Ray"], 1999)], "p string, reference_id string, number long, authors array<string>, year int")
    got = [(r.claim_id, r["rank"], r.reference_id, r.marker) for r in s.map_claims(claims, citations, references, "p").orderBy("claim_id", "rank").collect()]
    assert got == [("C1", 1, "R1", "[1, 2]"), ("C1", 2, "R2", "[1, 2]"), ("C1", 3, "R3", "(Lee, 2020)"), ("C3", 1, "R4", "Ray et al. (1999)")]
    assert s.map_claims(claims.limit(0), citations, references, "p").count() == 0


def by_hand(spark, refs, ground):
    """Every pair of a document, with the library's own title similarity."""
    pairs = [(d, n, t, m, g) for d, n, t in refs for e, m, g in ground if e == d]
    df = spark.createDataFrame(pairs, "d int, n int, t string, m int, g string").withColumn("s", fuzzy.title_similarity(F.col("t"), F.col("g")))
    sim = {(r.d, r.n, r.m): r.s for r in df.collect()}
    out = {}
    for d, n, t in refs:
        rows = [(m, g) for e, m, g in ground if e == d]
        here = next(((m, g) for m, g in rows if m == n), None)
        chosen = None if here is None else n
        if t and len(t) > 10:
            good = [(m, sim[d, n, m]) for m, g in sorted(rows) if g and sim[d, n, m] >= 0.70]
            if here is None:
                chosen = good[0][0] if good else None
            elif here[1] and sim[d, n, n] < 0.35 and len(rows) > 1 and good:
                chosen = max(good, key=lambda x: (x[1], -x[0]))[0]
        out[d, n] = chosen
    return out


def test_places_by_hand(spark):
    rng = random.Random(7)
    titles = [f"{a} {b} of {c} systems" for a in ("deep", "shallow", "robust", "fair") for b in ("learning", "ranking", "parsing", "clustering") for c in ("large", "small")]
    refs, ground = [], []
    for d in range(12):
        mine = rng.sample(titles, 9)
        refs += [(d, n, None if rng.random() < 0.05 else t if rng.random() < 0.8 else t[:8]) for n, t in enumerate(mine)]
        moved = mine[1:] + mine[:1] if d % 2 else mine
        ground += [(d, n, (t + " revisited" if rng.random() < 0.2 else t.title())) for n, t in enumerate(moved) if rng.random() < 0.8]
    refs += [(90, 0, "electroencephalographically"), (91, 0, "only one row here"), (92, 0, "no ground at all")]
    ground += [(90, 5, "electroencephalographicallyx"), (91, 0, "something else entirely")]
    schema = "doc int, reference_no int, title string"
    out = s.repaired_places(spark.createDataFrame(refs, schema), spark.createDataFrame(ground, schema), "doc")
    got = {(r.doc, r.reference_no): r.ground_no for r in out.collect()}
    assert got == by_hand(spark, refs, ground)
    assert got[90, 0] == 5 and got[91, 0] == 0 and got[92, 0] is None and out.filter("repaired").count() > 10


def test_places_are_repaired_alike_with_few_rows_and_many(spark, monkeypatch):
    titles = some_texts(40, 11, 2, 6)
    refs = [(d, i + 1, titles[(7 * d + i) % 40]) for d in range(8) for i in range(6)]
    ground = [(d, i + 1 + d % 2, titles[(7 * d + i) % 40].upper()) for d in range(8) for i in range(6)]
    a, b = (spark.createDataFrame(x, "d int, reference_no int, title string") for x in (refs, ground))
    found = []
    for few in (0, s.FEW):
        monkeypatch.setattr(s, "FEW", few)
        found.append(sorted(map(tuple, s.repaired_places(a, b, "d").collect())))
    assert found[0] == found[1] and any(r[3] for r in found[0])
