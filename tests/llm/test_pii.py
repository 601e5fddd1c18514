import random
import re

import numpy as np

from quillstone.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_those_of_the_patterns(docs):
    rng = random.Random(3)
    texts = [r.text for r in docs.collect()]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for alphabet in ("ab0123456789..@@+-- ()%_é\n", "0149 -.+") for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_little_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1 " * 60_000, "(" * 200_000, "a-" * 100_000, "a- at " * 40_000, "Mr A" + "a" * 200_000, "Mr Aa " * 40_000, "f" * 200_000, "sk-" * 70_000, "key_" * 50_000 + "= " + "ab12" * 9):
        pii.candidates(t, pii.base_spans(t))


def test_expectation_maximisation_finds_the_truth():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    good = np.array([0.9, 0.85, 0.7])
    votes = np.stack([np.where(rng.random(4000) < g, truth, ~truth) * 2 - 1 for g in good], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, table = pii.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(table[:, 1, 2] - good).max() < 0.06
    likely = {tuple(k): v for k, v in zip(patterns.tolist(), p, strict=True)}
    assert np.mean([(likely[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.88


def test_spans_of_a_table(spark):
    rows = [(1, "write to a.b@c.example.com or +1 (212) 555-0123"), (2, "card 4111 1111 1111 1111 at 10.0.0.1"), (3, None), (4, ""), (4, ""), (5, "no data here"), (6, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    got = {(r.doc_id, s["kind"], s["start"], s["end"]) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans}
    assert {(1, "email", 9, 26), (1, "phone", 30, 47), (2, "card", 5, 24), (2, "ip", 28, 36)} <= got
    assert not {d for d, *_ in got} & {3, 4, 5}


def test_a_number_that_runs_into_another():
    text = "call +1 (826) 555-4081 190.137.2.4 now, not v1.2.3 or 12345"
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in base] == [("ip", "190.137.2.4")]
    assert [(k, text[a:b]) for a, b, k in pii.candidates(text, base)] == [("phone", "+1 (826) 555-4081")]


def test_odd_rows(odd, none):
    assert pii.find_personal_data(odd).count() == 10
    assert pii.find_personal_data(none).count() == 0
    assert pii.mask("a b@c.de f", [{"kind": "email", "start": 2, "end": 8}]) == "a <EMAIL> f"


def test_secrets_of_any_length():
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.candidates(t, []) if k == "secret"]
    short, hexes, key = "sk-" + "a1B2" * 4, "0a1b2c3d" * 25, "sk-proj-" + "aB3_x-9Z" * 20
    for secret in (short, "pk_" + "a1B2" * 4, hexes, key):
        assert found(f"use {secret} here") == [("secret", secret)]
    assert found("use sk-a1B2a1B2a1B2a1B here") == found(f"use {hexes}g here") == []


def test_columns_of_the_query_against_plain_code(spark, docs):
    import hashlib

    from quillstone.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op3_pii"](spark, "/root/testdata/sf0.001").collect()}
    added = 0
    for d in docs.collect():
        base, r = brute(d.text or ""), rows[d.doc_id]
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(join(base).split(",")) - {""} <= set(spans) and r.n_spans == len(spans)
        assert r.n_secret == sum(s.startswith("secret:") for s in spans) and r.n_person == sum(s.startswith("person:") for s in spans)
        order = [(int(s.split(":")[1]), (pii.KINDS + pii.EXTRA).index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
        wider = {f"{k}:{a}:{b}" for a, b, k in pii.candidates(d.text or "", pii.base_spans(d.text or ""))}
        assert set(spans) - set(join(base).split(",")) <= wider
        added += len(spans) - len(base)
    assert len(rows) == docs.count() and added > 0


def test_candidates_have_no_longest():
    email, person = "a" * 300 + " [at] example [dot] com", "Mr " + "A" + "b" * 60
    assert [t[a:b] for t in (f"to {email} now", f"to {person} now") for a, b, _ in pii.candidates(t, [])] == [email, person]


def test_gazetteers_vote_on_secrets():
    at = pii.LABELERS.index("gazetteer")
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    assert pii.votes(f'api_key = "{secret}"', 11, 43, "secret")[at] == 1 and pii.votes("ghp_" + secret, 0, 36, "secret")[at] == 1
    assert pii.votes(f"sum {secret}", 4, 36, "secret")[at] == 0
