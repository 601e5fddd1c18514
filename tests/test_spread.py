"""Long work on each row is dealt out over as many parts as a shuffle has, whatever the rows are read from."""

import random
import re
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import bibliographies, citations
from quillstone.operators import discovery


def _parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def _one_part(spark, rows, kind):
    return spark.createDataFrame(rows, kind).coalesce(1)


def test_markers_of_one_part(spark):
    df = _one_part(spark, [(i, f"As in [{i}] and (Lee, 2012).") for i in range(200)], "id int, body string")
    assert _parts(bibliographies.scan_markers(df, "id", "body")) == 4


def test_links_of_one_part(spark):
    df = _one_part(spark, [(str(i), f"See https://x.org/{i} there.") for i in range(200)], "case_id string, text string")
    assert _parts(discovery.links(df)) == 4


def test_small_tables_of_queries(spark):
    for name in ("tvf03_unmerged_references", "sc41_author_similarity"):
        assert _parts(entry.queries()[name](spark, "/root/testdata/sf0.001")) == 4, name


def _plain_split(text):
    tokens = [t.strip(" ") for t in re.sub(r"\s+", " ", text).split(";")]
    tokens, held, done = [t for t in tokens if t], [], []
    for i, t in enumerate(tokens):
        held.append(t)
        author = bool(re.search(citations.AUTHOR_START, tokens[i + 1])) if i + 1 < len(tokens) else False
        closed = re.search(citations.YEAR_AT_END, t) or (author and (re.search(citations.YEAR_ANYWHERE, t) or re.search(citations.LINK_AT_END, t)))
        if closed or (author and len(held) >= 3 and re.search(citations.JOURNAL_CUE, " ".join(held))):
            done.append(("; ".join(held), [] if closed else ["SPLIT_ON_AUTHOR_BOUNDARY_WITHOUT_YEAR"]))
            held = []
    return done + ([("; ".join(held), ["TRAILING_REMAINDER_NO_CLOSING_YEAR", "TRAILING_REMAINDER"])] if held else [])


def test_references_of_a_text_are_those_of_the_plain_fold(spark):
    rng = random.Random(7)
    of = ["Lee A.", "Fox B., On nets", "a title", "pp. 3-4", "Vol. 2 no. 3", "(2012)", "(2012a) more", "doi: 10.1234/ab", "Poe C.D., Logs, pp. 2, (1999)", "", " "]
    texts = ["; ".join(rng.choice(of) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", citations.split_references(F.col("t")).alias("r"))
    for row in df.collect():
        assert [(x.raw, x.reasons) for x in row.r] == _plain_split(texts[row.i]), texts[row.i]


def test_time_of_a_long_text_grows_with_its_length(spark):
    def seconds(n):
        df = spark.createDataFrame([("k", "; ".join(f"Smith J., On nets {i}, pp. {i}, (1999)" for i in range(n)))], "k string, t string")
        began = time.time()
        assert citations.references(df, "k", "t").select("raw_reference").distinct().count() == n
        return time.time() - began

    seconds(100)
    assert seconds(24_000) < 12 * max(2.0, seconds(2_000))
