"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span model decides.

1. One pass over the texts finds the base spans (fixed patterns and checks) and further candidates, which
   wider patterns catch: spans of the base kinds that a check drops or that are written otherwise, keys and
   tokens, names after a title. Each candidate has the votes of regex, gazetteer and context labelers.
2. The vote patterns of all candidates are counted. Expectation-maximisation over these counts, whose
   number is bounded by the number of patterns, estimates each labeler's reliability and each pattern's
   probability of being personal data, kind by kind.
3. A logistic span model learns those probabilities from features of the spans, on the counted feature
   patterns. Candidates at its threshold are added. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "person")
THRESHOLD = 0.9

LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
#: The base pattern has any of \x20 and - between digits: the class [\x20-] holds just these two.
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Wider patterns for candidates.
AT_WORD = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]++)+", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-][0-9]{2,5}){2,4}(?![\w.-]?[0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,}+|AKIA[A-Z0-9]{16}|(?:gh[pousr]|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-zà-ÿ]++(?: [A-Z][a-zà-ÿ]++){0,2}")
#: Cheap signs without which a pattern cannot match.
AT_SIGN = re.compile(r"[\[({] ?at ?[\])}]", re.I)
DIGIT = re.compile(r"[0-9]")
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")
#: The shortest secret has as many characters: sk- or pk- and 16 more.
LONG_WORD = 19

#: Gazetteers: ends of domains, country calling codes by first digits, issuer prefixes, common given names.
DOMAIN_ENDS = frozenset("com org net edu gov info biz io de fr es it nl eu uk us ca au ch at be pl se no dk fi pt br mx ar jp cn in ru".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
GIVEN = frozenset("james john robert michael william david richard joseph thomas mary patricia jennifer linda elizabeth susan jessica sarah karen anna peter paul hans maria jean pierre marie claire jose juan carlos luis ana carmen laura".split())
#: How issuers' keys begin, and names that keys are assigned to.
KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_", "pk-", "pk_", "xoxa-", "xoxb-", "xoxp-")
KEY_NAMES = re.compile(r"\b(?:[a-z0-9]+[_-])*(?:token|secret|password|passwd|key|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?$", re.I)
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|adresse|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|amex|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|fax|mobile|telefon|téléphone|teléfono)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[ _-]?key|key|auth|bearer)\b", re.I),
    "person": re.compile(r"\b(?:name|dear|contact|signed|author|regards)\b", re.I),
}
#: Words before a number that speak against personal data.
AGAINST = re.compile(r"(?:\b(?:version|release|v|section|chapter|isbn|issn|doi|fig|figure|table|page|pp|no|order|license)\b[.:# ]*|[$€£#])$", re.I)
LABELERS = ("form", "check", "gazetteer", "near", "against", "alone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans, by start and kind; and nothing else."""
    out = [(a, b, "email") for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if _octets(m[0])]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further spans that may be personal data, none of them overlapping a base span or one another."""
    found = [(m.start(), m.end(), "email") for m in AT_WORD.finditer(text)] if AT_SIGN.search(text) else []
    if any(t in text for t in TITLES):
        found += [(m.start(), m.end(), "person") for m in TITLED.finditer(text)]
    if max(map(len, text.split()), default=0) >= LONG_WORD:
        found += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if not m[0].isdigit()]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
        found += [(m.start(), m.end(), "phone") for m in LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    if not found:
        return []
    taken = sorted((a, b) for a, b, _ in base)
    out: list[tuple[int, int, str]] = []
    i = last = 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < last or (i < len(taken) and taken[i][0] < b):
            continue
        out.append((a, b, kind))
        last = b
    return out


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """One vote of each of LABELERS: 1 for, -1 against, 0 none."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = _digits(span)
    form = check = gazetteer = 0
    if kind == "email":
        form = 1
        check = 1 if "@" in span else 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span.rstrip(")]} "))[-1].lower() in DOMAIN_ENDS else -1
    elif kind == "ip":
        form = 1 if _octets(span) else -1
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        form = 1 if len(digits) == 16 else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        form = 1 if span.startswith(("+", "(")) else 0
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if digits.startswith(CALLING) and span[0] == "+" else 0
    elif kind == "secret":
        form = 1
        check = 1 if len(set(span)) >= 10 else -1
        gazetteer = 1 if span.startswith(KEY_STARTS) or KEY_NAMES.search(before) else 0
    else:
        form = 1
        gazetteer = 1 if any(w.lower() in GIVEN for w in span.split()) else 0
    near = 1 if CONTEXT[kind].search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = 1 if not (left.isalnum() or right.isalnum()) else -1
    return form, check, gazetteer, near, against, alone


def features(text: str, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Votes and shape of a span in few values each, so that patterns stay countable."""
    span = text[start:end]
    return [*vote, min(3, (end - start) // 8), int(any(c.isdigit() for c in span)), int(any(c.isalpha() for c in span)), int(start == 0 or text[start - 1] == "\n")]


SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("pattern", pa.list_(pa.int8()))])
SPANS_DDL = "doc_id long, spans array<struct<start: long, end: long, kind: string, base: boolean, pattern: array<tinyint>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py() or ""
            spans = []
            base = base_spans(text)
            for own, some in ((True, base), (False, candidates(text, base))):
                spans += [{"start": a, "end": b, "kind": k, "base": own, "pattern": features(text, a, b, votes(text, a, b, k))} for a, b, k in some]
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPANS))], names=["doc_id", "spans"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each vote pattern, and each labeler's (truth, vote) table, for votes -1, 0 and 1.

    Labelers are independent given the truth, and start a little better than chance. One pseudo-count in
    each cell keeps labelers that never vote from deciding.
    """
    table = np.empty((patterns.shape[1], 2, 3))
    table[:, 1] = (0.15, 0.3, 0.55)
    table[:, 0] = (0.55, 0.3, 0.15)
    share, at = prior, patterns + 1
    p = np.full(len(patterns), prior)
    for _ in range(rounds):
        logs = np.log(table)
        odds = np.log(share / (1 - share)) + sum(logs[j, 1, at[:, j]] - logs[j, 0, at[:, j]] for j in range(at.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done, p = np.abs(new - p).max() < 1e-6, new
        for j in range(at.shape[1]):
            for truth, weight in ((1, p), (0, 1 - p)):
                c = np.bincount(at[:, j], counts * weight, minlength=3) + (np.array([0.3, 0.6, 1.1]) if truth else np.array([1.1, 0.6, 0.3]))
                table[j, truth] = c / c.sum()
        share = float(np.clip((counts @ p + 1) / (counts.sum() + 2), 0.02, 0.98))
        if done:
            break
    return p, table


def span_model(patterns: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model for soft targets, by Newton's method."""
    x = np.concatenate((patterns, np.ones((len(patterns), 1))), axis=1).astype(float)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - target)) + ridge @ w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge
        d = np.clip(np.linalg.solve(h, g), -2, 2)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and spans (start, end, kind, base, probability).

    Offsets are code points, ends exclusive; spans are sorted by start, then kind as listed. A null text is
    empty and has none; texts are read whole, however long. Base spans never leave. Repeated rows and rows with
    one doc_id each have a row and count each among the votes. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    slim = docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").alias("text"))
    found = checkpointed(slim.mapInArrow(_find, SPANS_DDL))
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.pattern")
    # At most one row for each pattern that can occur: a fixed number, whatever the corpus.
    rows = each.groupBy("kind", "pattern").agg(F.count("*").alias("n")).collect()
    table: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in KINDS + EXTRA:
        of_kind = sorted((tuple(r.pattern), r.n) for r in rows if r.kind == kind)
        if not of_kind:
            continue
        patterns, counts = np.array([p for p, _ in of_kind], int), np.array([n for _, n in of_kind], float)
        likely, _ = expectation_maximisation(patterns[:, : len(LABELERS)], counts)
        w = span_model(patterns, likely, counts)
        scores = 1 / (1 + np.exp(-np.clip(patterns @ w[:-1] + w[-1], -30, 30)))
        table |= {(kind, p): float(s) for (p, _), s in zip(of_kind, scores, strict=True)}
    order = {k: i for i, k in enumerate(KINDS + EXTRA)}
    schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                scored = [{"start": s["start"], "end": s["end"], "kind": s["kind"], "base": s["base"], "probability": table[s["kind"], tuple(s["pattern"])]} for s in spans]
                rows.append(sorted((s for s in scored if s["base"] or s["probability"] >= threshold), key=lambda s: (s["start"], order[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, schema)], names=["doc_id", "spans"])

    return found.mapInArrow(keep, "doc_id long, spans array<struct<start: long, end: long, kind: string, base: boolean, probability: double>>")


def mask(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = s["end"]
    return "".join([*out, text[at:]])


def digest(spans: list) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
