"""Phrase collocation mining: frequent words become numbers, phrases of them fixed-width keys, which are sorted and counted.

Words are counted by language, and those with at least ``LEAST`` occurrences are numbered. Each number is four bytes
of a key, so that a phrase of n words is a binary key of 4 n bytes, whose order and parts need no words; since numbers
are given by language and word, a key has one language. Pieces break where a word has no number: no phrase with a rarer
word can be frequent. Each map task sorts its keys by radix, counts runs and deals them out by ranges of their spread
bits; a range's runs meet in one task, are sorted and counted in the same way. Ranges follow the number of words, so
that a task holds a few million keys however large the table, and a phrase in every text is one run for each map task.

Pairs are counted first. A filter of their bits then tells where phrases of three and four words can be frequent.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import checkpointed, name, small
from quillstone.llm.words import mixed

#: Occurrences that a phrase needs, words that it has at most, and phrases returned for each language.
LEAST, MOST_WORDS, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this per cent of its occurrences.
HELD = 80
#: Lower-case letters for capitals, full stops for the other ends of a piece, blanks for tabs.
FORM = bytes(ord(".") if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of the dictionary, and bytes in them, up to which it is broadcast; beyond, words are joined with it.
DICTIONARY_WORDS, DICTIONARY_BYTES = 1_000_000, 32_000_000
#: Keys that a map task sorts at a time; words for each range; the number of ranges at least.
SORT_KEYS, RANGE_WORDS, LEAST_RANGES = 1_000_000, 4_000_000, 256
#: Distinct words that a map task counts at a time.
COUNTED_WORDS = 400_000
#: Log of the bits in the filter of frequent pairs, at most. A fuller filter lets more phrases be counted in vain.
FILTER_BITS = 27
#: Rows of a hot word go to this many tasks where words are joined with the dictionary.
SALTS = 16


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text, with b'.' between pieces."""
    return text.translate(FORM).replace(b".", b" . ").split()


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(name("lang"), F.lit("und")).alias("lang"), F.coalesce(name("text"), F.lit("")).cast("binary").alias("text"))


WORDS = "lang string, word binary, f long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and word; a null word has the number of all words of its language."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        for of in counts.values():
            of.pop(b".", None)
            of[None] = of.total()
        langs, words, f = [], [], []
        for lang, of in counts.items():
            langs += repeat(lang, len(of))
            words += of.keys()
            f += of.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(tokens_of(text.as_py()))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield rows(counts)
                counts = {}
    if counts:
        yield rows(counts)


def count_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word and f of the words with at least ``least`` occurrences; the row with a null word has all of a lang."""
    counts = _slim(docs).mapInArrow(_count_words, WORDS).groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counts.filter((F.col("f") >= least) | F.col("word").isNull())


def numbered(words: DataFrame) -> DataFrame:
    """Number the rows of ``words`` from 1, without gaps: lang, word, f, id and key, the id's four bytes."""
    placed = checkpointed(words.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 1
    for p, n in sizes:
        starts.append((p, at))
        at += n
    if at > 2**32:
        raise ValueError("more frequent words than four bytes can number")
    starts = F.broadcast(words.sparkSession.createDataFrame(starts, "part long, start long"))
    ids = placed.withColumn("part", part).join(starts, "part").withColumn("id", F.col("start") + F.col("place").bitwiseAND(2**33 - 1))
    return ids.select("lang", "word", "f", "id", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"))


def _reader(shared):
    """Reads texts as numbers of words by a broadcast dictionary of each language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        known = shared.value
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if of := known.get(lang.as_py()):
                    words = tokens_of(text.as_py())
                    yield np.fromiter(map(of.get, words, repeat(0)), np.uint32, len(words)), 1

    return read


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Numbers that were joined before, with the times that their piece occurs."""
    for batch in batches:
        for ids, times in zip(batch.column("ids"), batch.column("times").to_pylist(), strict=True):
            yield ids.values.to_numpy().astype(np.uint32), times


def encoded(docs: DataFrame, dictionary: DataFrame, most_words: int = DICTIONARY_WORDS, most_bytes: int = DICTIONARY_BYTES):
    """A table, and the function that reads lists of numbers (0: a break) from its batches in a worker.

    A dictionary within the bounds is broadcast, and texts are encoded where they are read. Beyond, equal pieces are
    made one, with the times that they occur, and their words are joined with the dictionary, a frequent word's rows
    dealt to ``SALTS`` tasks.
    """
    n, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n <= most_words and size <= most_bytes:
        known: dict[str, dict[bytes, int]] = {}
        for r in dictionary.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r.lang, {})[bytes(r.word)] = r.id
        return _slim(docs), _reader(docs.sparkSession.sparkContext.broadcast(known))
    lower = F.translate(F.coalesce(name("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = docs.select(F.coalesce(name("lang"), F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    pieces = pieces.groupBy("lang", "piece").agg(F.count("*").alias("times")).withColumn("of", F.sha2(F.col("piece").cast("binary"), 256))
    words = pieces.select("lang", "of", "times", F.posexplode(F.regexp_extract_all("piece", F.lit(r"[^\x20\x09]+"), F.lit(0))).alias("pos", "word"))
    words = words.select("lang", "of", "times", "pos", F.col("word").cast("binary").alias("word"), (F.col("pos") % SALTS).alias("salt"))
    known = dictionary.select("lang", "word", "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = words.join(known, ["lang", "word", "salt"], "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))), lambda s: s["id"])
    return found.groupBy("lang", "of").agg(F.max("times").alias("times"), ids.alias("ids")).select("ids", "times"), _given


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of unsigned numbers, the first column the most significant: a radix sort by 16-bit digits."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        top = int(column.max()) if len(column) else 0
        for shift in range(0, max(1, top.bit_length()), 16):
            digit = ((column >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # for 16 bits, numpy's stable sort is a radix sort
    return order


def spread(ids: np.ndarray) -> np.ndarray:
    """64 bits for each row of numbers."""
    out = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        out = mixed(out ^ ids[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def ranges_of(ids: np.ndarray, ranges: int) -> np.ndarray:
    return ((spread(ids) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)


def runs(lead: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort rows by ``lead`` and ``ids`` and count each distinct one once, with the sum of its times."""
    order = radix_order([lead, *ids.T])
    lead, ids, times = lead[order], ids[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1) | (lead[1:] != lead[:-1])])) if len(ids) else np.zeros(0, int)
    return lead[first], ids[first], np.add.reduceat(times, first) if len(first) else times


RUNS = "n int, range long, keys binary, times binary"
RUNS_ARROW = pa.schema([("n", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])


def _dealt(n: int, ids: np.ndarray, times: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of keys as one row for each range."""
    lead, ids, times = runs(ranges_of(ids, ranges), ids, times)
    edges = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1], [True]])) if len(lead) else np.zeros(1, int)
    packed = ids.astype(">u4")
    for at in range(0, len(edges) - 1, 256):
        some = list(zip(edges[at : at + 256].tolist(), edges[at + 1 : at + 257].tolist(), strict=False))
        columns = [[n] * len(some), [int(lead[a]) for a, _ in some], [packed[a:b].tobytes() for a, b in some], [times[a:b].astype("<i8").tobytes() for a, b in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS_ARROW, strict=True)], schema=RUNS_ARROW)


def _windows(ids: np.ndarray, times: np.ndarray, n: int, live) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n numbers in a row without a break, at places where all pairs are live."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros((0, n), np.uint32), times[:0]
    ok = np.ones(size, bool)
    for k in range(n):
        ok &= ids[k : k + size] > 0
    if live is not None:
        for k in range(n - 1):
            ok &= live[k : k + size]
    at = np.flatnonzero(ok)
    return np.stack([ids[at + k] for k in range(n)], axis=1), times[at]


def _count(table: DataFrame, read, sizes: tuple[int, ...], ranges: int, least: int, pairs=None, bits: int = 0) -> DataFrame:
    """Phrases of each of ``sizes`` words with at least ``least`` occurrences: n, key, f."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, size = [], [], 0
        alive = None if pairs is None else np.frombuffer(pairs.value, np.uint8)

        def flush():
            ids, times = np.concatenate(held), np.concatenate(weights)
            live = None
            if alive is not None and len(ids) > 1:
                spot = spread(np.stack([ids[:-1], ids[1:]], axis=1)) >> np.uint64(64 - bits)
                live = (alive[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            for n in sizes:
                yield from _dealt(n, *_windows(ids, times, n, live), ranges)

        for ids, times in read(batches):
            held += [ids, np.zeros(1, np.uint32)]
            weights += [np.full(len(ids) + 1, times, np.int64)]
            size += len(ids) + 1
            if size >= SORT_KEYS:
                yield from flush()
                held, weights, size = [], [], 0
        if held:
            yield from flush()

    def gather(rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        ids = np.frombuffer(b"".join(rows.column("keys").to_pylist()), ">u4").reshape(-1, n).astype(np.uint32)
        times = np.frombuffer(b"".join(rows.column("times").to_pylist()), "<i8")
        _, ids, times = runs(np.zeros(len(ids), np.uint32), ids, times)
        kept = times >= least
        ids, times = ids[kept], times[kept]
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(ids), [None, pa.py_buffer(ids.astype(">u4").tobytes())]).cast(pa.binary())
        top = (spread(ids) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return pa.table({"n": pa.array(np.full(len(ids), n, np.int32)), "key": keys, "f": pa.array(times), "spot": pa.array(top)})

    return table.mapInArrow(deal, RUNS).groupBy("n", "range").applyInArrow(gather, "n int, key binary, f long, spot long")


def pair_filter(pairs: DataFrame) -> tuple[bytes, int]:
    """A filter in which the bits of all ``pairs`` are set, and the log of its size: 64 bits a pair, 16 MB at most."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(64 * max(1, pairs.count())))))
    spot = F.shiftright("spot", FILTER_BITS - bits) + 1  # bits and buckets (of 32,768 bits) are numbered from 1
    rows = pairs.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bitmap")).collect()
    out = bytearray(2**bits // 8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bitmap
    return bytes(out), bits


def _words(key: Column, start: int, count: int) -> Column:
    return F.substring(key, 4 * start + 1, 4 * count)


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Add lang, l, r and score, those of the cut that scores least (of several, the first), to each candidate key."""
    parts = []
    for n in range(2, MOST_WORDS + 1):
        of = [F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (_words(F.col("key"), 0, k) if left else _words(F.col("key"), k, n - k)).alias("part")) for k in range(1, n) for left in (True, False)]
        parts.append(F.when(F.col("n") == n, F.array(*of)))
    asked = candidates.select("key", "n", F.col("f").alias("a"), F.explode(F.coalesce(*parts)).alias("p")).select("key", "n", "a", "p.*")
    known = counts.select(F.col("key").alias("part"), F.col("f").alias("part_f"), "lang")
    cuts = asked.join(small(known), "part").groupBy("key", "n", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r"), F.max(F.when(F.col("left") & (F.col("k") == 1), F.col("lang"))).alias("lang")
    )
    # a is at most l and r, so the quotient fits in a long; the product may not, and is a decimal.
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("key", "n", "a").agg(worst.alias("w"), F.max("lang").alias("lang")).select("lang", "key", "n", "a", "w.l", "w.r", "w.score")


def not_held(candidates: DataFrame, of: DataFrame, held: int = HELD) -> DataFrame:
    """The rows of ``candidates`` (key, a) that no longer phrase of ``of`` (key, n, f) holds nearly as often."""
    parts = [F.when(F.col("n") == n, F.array(*[_words(F.col("key"), s, m) for m in range(2, n) for s in range(n - m + 1)])) for n in range(3, MOST_WORDS + 1)]
    inside = of.filter("n > 2").select(F.explode(F.coalesce(*parts)).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    return candidates.join(inside, "key", "left").filter(F.expr(f"longer is null or cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) < {held} * cast(a as decimal(20,0))")).drop("longer")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = DICTIONARY_WORDS) -> DataFrame:
    """The ``top`` phrases of two to four words of each language of ``docs`` (text, lang).

    Returns lang, rank, phrase, a (its occurrences), l and r (those of its parts at the cut that scores least), n (words
    of the language) and score. A null lang is ``und``, a null text empty; empty texts have no words. Texts are read
    whole, however long. Repeated rows each count. Equal scores are ranked by a, then by the phrase's bytes. Other
    columns, whatever their names, are not read. An empty table gives an empty result. ``least`` is at least 1.
    """
    words = checkpointed(count_words(docs, least))
    total = words.filter("word is null").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    dictionary = checkpointed(numbered(words.filter("word is not null")))
    ranges = max(LEAST_RANGES, math.ceil((total.agg(F.sum("n")).first()[0] or 0) / RANGE_WORDS))
    table, read = encoded(docs, dictionary, most_words)
    if read is _given:
        table = checkpointed(table)
    pairs = checkpointed(_count(table, read, (2,), ranges, least))
    packed, bits = pair_filter(pairs)
    longer = checkpointed(_count(table, read, tuple(range(3, MOST_WORDS + 1)), ranges, least, docs.sparkSession.sparkContext.broadcast(packed), bits))
    phrases = pairs.unionByName(longer).select("n", "key", "f")
    counts = checkpointed(dictionary.select("key", "f", "lang").unionByName(phrases.select("key", "f", F.lit(None).cast("string").alias("lang"))))
    left = not_held(scored(phrases, counts), phrases)
    # Ranks without words leave the ties at the last place in; only these phrases are spelt out.
    best = left.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substring(F.col("key"), 4 * k + 1, F.lit(4)))
    spelt = best.select("lang", "key", "a", "l", "r", "score", F.posexplode(ids).alias("pos", "id"))
    spelt = spelt.join(dictionary.select(F.col("key").alias("id"), F.col("word").cast("string").alias("word")), "id")
    words_of = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"])
    spelt = spelt.groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_join(words_of, " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = spelt.withColumn("rank", rank).filter(F.col("rank") <= top).join(total, F.col("lang") == F.col("of"))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, m, ws[i:i + m - 1] AS w, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) t(m) WHERE len(ws) >= m) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
counts AS (SELECT * FROM grams WHERE f >= 30),
candidates AS (SELECT * FROM counts WHERE m >= 2),
cuts AS (
  SELECT c.lang, c.m, c.w, c.f AS a, k, l.f AS l, r.f AS r, (2000000 * c.f::HUGEINT) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN counts r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (
  SELECT lang, w[s:s + len_ - 1] AS w, max(f) AS longer
  FROM (SELECT lang, m, w, f, len_, unnest(range(1, m - len_ + 2)) AS s FROM candidates, (VALUES (2), (3)) t(len_) WHERE len_ < m) GROUP BY ALL),
ranked AS (
  SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, l, r, score
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.w = s.w
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT ranked.lang, row_number() OVER (PARTITION BY ranked.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang)
QUALIFY rank <= 2000
"""
