"""Queries of bibliographies and citation markers: texts are put together from rows, and the rows have to come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import bibliographies
from quillstone.plans.registry import query
from quillstone.plans.tables import table

#: Lines of orders with what their entries say.
LINES_SQL = """
lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name, 1990 + l_linenumber AS yr, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS surname,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _lines(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").join(part, "l_partkey")
    return lines.withColumn("yr", F.col("l_linenumber") + 1990).withColumn("surname", F.initcap(F.substring_index("p_name", " ", 1)))


def _texts(lines: DataFrame, entry, between) -> DataFrame:
    """One text per order of its lines' entries, an entry being made of the line's place and columns."""
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_name", "yr", "surname")))
    orders = lines.groupBy("l_orderkey").agg(listed.alias("of"))
    return orders.select("l_orderkey", F.array_join(F.transform("of", lambda x, i: F.concat(entry(x, i + 1), F.when(i + 1 < F.size("of"), between).otherwise(""))), "").alias("text"))


def _dated(x):
    return F.concat(x["surname"], F.lit(", Ian, Ryan Cassidy, and Esther De Leon. "), x["yr"].cast("string"), F.lit(". “"), x["p_name"], F.lit(":\nwhat users say.” Journal of Web Studies 7 (4):"), x["l_suppkey"].cast("string"), F.lit("–9. http://dx.doi.org/10.1080/"), x["l_partkey"].cast("string"), F.lit("."))


def _linked(x):
    return F.concat(F.lit("Luke "), x["surname"], F.lit(", Jamie Ryan Kiros, and Sonal Gupta. On "), x["p_name"], F.lit(" that explains the\neffectiveness of tuning. Preprint, December "), x["yr"].cast("string"), F.lit(". URL\nhttp://arxiv.org/abs/"), x["l_partkey"].cast("string"), F.lit("."))


def _late(x):
    return F.concat(F.lit("Ricardo "), x["surname"], F.lit(". A study of "), x["p_name"], F.lit(" by\nmany. In Proceedings "), x["l_suppkey"].cast("string"), F.lit(", "), x["yr"].cast("string"), F.lit("."))


DATED_SQL = "surname || ', Ian, Ryan Cassidy, and Esther De Leon. ' || yr || '. “' || p_name || ': what users say.” Journal of Web Studies 7 (4):' || l_suppkey || '–9. http://dx.doi.org/10.1080/' || l_partkey || '.'"
LINKED_SQL = "'Luke ' || surname || ', Jamie Ryan Kiros, and Sonal Gupta. On ' || p_name || ' that explains the effectiveness of tuning. Preprint, December ' || yr || '. URL http://arxiv.org/abs/' || l_partkey || '.'"
LATE_SQL = "'Ricardo ' || surname || '. A study of ' || p_name || ' by many. In Proceedings ' || l_suppkey || ', ' || yr || '.'"


@query("tvf04_author_date", f"""
WITH {LINES_SQL}
SELECT l_orderkey, k::INTEGER AS number, CASE l_orderkey % 3 WHEN 0 THEN {DATED_SQL} WHEN 1 THEN {LINKED_SQL} ELSE {LATE_SQL} END AS raw FROM lines""")
def tvf04(spark, sf):
    """Entries of wrapped author-date bibliographies in three shapes: year first, link last, year last."""
    entry = lambda x, i: F.when(F.col("l_orderkey") % 3 == 0, _dated(x)).when(F.col("l_orderkey") % 3 == 1, _linked(x)).otherwise(_late(x))
    return bibliographies.author_date_references(_texts(_lines(spark, sf), entry, F.lit("\n")), "l_orderkey", "text")


@query("tvf02_manuscript", f"""
WITH {LINES_SQL},
entries AS (SELECT *, 'A. ' || surname || ', Study of ' || p_name || ', pp. ' || l_suppkey || '-9, ' || yr AS entry FROM lines)
SELECT l_orderkey, CASE WHEN n = 1 OR l_orderkey % 5 >= 3 THEN 'loose' WHEN l_orderkey % 5 = 2 THEN 'author_date' ELSE 'numbered' END AS strategy, k::INTEGER AS number,
       CASE l_orderkey % 5 WHEN 0 THEN '[' || k || '] ' || entry WHEN 1 THEN k || '. ' || entry WHEN 2 THEN {LATE_SQL}
            WHEN 3 THEN 'the study of ' || p_name || ' in part ' || l_suppkey ELSE 'some study of ' || p_name || ', part ' || l_suppkey END AS raw
FROM entries WHERE n > 1 OR l_orderkey % 5 <> 2
UNION ALL SELECT l_orderkey, 'loose', 1, 'Ricardo ' || surname || '. A study of ' || p_name || ' by' FROM entries WHERE n = 1 AND l_orderkey % 5 = 2
UNION ALL SELECT l_orderkey, 'loose', 2, 'many. In Proceedings ' || l_suppkey || ', ' || yr || '.' FROM entries WHERE n = 1 AND l_orderkey % 5 = 2""")
def tvf02(spark, sf):
    """Entries of bibliographies in five shapes: brackets, numbers in a line, author-date, paragraphs, semicolons.

    One author-date entry alone is no such bibliography: its two lines are taken for two entries.
    """
    kind = F.col("l_orderkey") % 5

    def entry(x, i):
        plain = F.concat(F.lit("A. "), x["surname"], F.lit(", Study of "), x["p_name"], F.lit(", pp. "), x["l_suppkey"].cast("string"), F.lit("-9, "), x["yr"].cast("string"))
        number = i.cast("string")
        return (
            F.when(kind == 0, F.concat(F.lit("["), number, F.lit("] "), plain)).when(kind == 1, F.concat(number, F.lit(". "), plain)).when(kind == 2, _late(x))
            .when(kind == 3, F.concat(F.lit("the study of "), x["p_name"], F.lit("\nin part "), x["l_suppkey"].cast("string")))
            .otherwise(F.concat(F.lit("some study of "), x["p_name"], F.lit(", part "), x["l_suppkey"].cast("string")))
        )

    between = F.when(kind == 3, "\n\n").when(kind == 4, "; ").when(kind == 1, " ").otherwise("\n")
    return bibliographies.manuscript_references(_texts(_lines(spark, sf), entry, between), "l_orderkey", "text")


#: The pieces of a text about each part: what each is, if a marker, and its text.
PIECES_SQL = """
pieces AS (
  SELECT p_partkey, unnest([
    {'form': '', 'marker': '', 't': 'As shown '}, {'form': 'NUMERIC_BRACKETED', 'marker': '', 't': '[' || p_size || ']'}, {'form': '', 'marker': '', 't': ' and '},
    {'form': 'NUMERIC_BRACKETED', 'marker': '', 't': '[' || p_size || '–' || (p_size + 2) || ', 9]'}, {'form': '', 'marker': '', 't': repeat(' (see below)', p_partkey % 3) || ', '},
    {'form': 'AUTHOR_YEAR_NARRATIVE', 'marker': '', 't': upper(substr(p_name, 1, 1)) || substr(p_name, 2, 2) || 'ton and Lee (' || (1950 + p_size) || 'a)'}, {'form': '', 'marker': '', 't': ' agreed '},
    {'form': 'AUTHOR_YEAR_PARENTHETICAL', 'marker': '', 't': '(Fox et al. ' || (1950 + p_size) || ', 12; Lee 2012, 47)'}, {'form': '', 'marker': '', 't': '. Table (2020) says so'},
    {'form': CASE WHEN p_partkey % 2 = 1 THEN 'NUMERIC_SUPERSCRIPT' ELSE '' END, 'marker': '', 't': CASE WHEN p_partkey % 2 = 1 THEN '¹²⁻¹⁴' ELSE '' END},
    {'form': '', 'marker': '', 't': ' ' || repeat('other ', 25)}, {'form': 'NUMERIC_PARENTHETICAL', 'marker': '', 't': '(' || p_size || ', 5)'}, {'form': '', 'marker': '', 't': ' too' || chr(10)},
    {'form': 'FOOTNOTE_NOTE', 'marker': '[' || p_size || ']', 't': '[Footnote] ' || p_size || '. ' || p_name},
    {'form': CASE WHEN p_partkey % 4 = 3 THEN 'FOOTNOTE_NOTE' ELSE '' END, 'marker': '[Footnote]', 't': CASE WHEN p_partkey % 4 = 3 THEN '[note] ' || p_name ELSE '' END}]) AS p,
    generate_subscripts(range(15), 1) AS seq
  FROM part),
placed AS (SELECT p_partkey, seq, p.form AS form, p.marker AS marker, p.t AS t, coalesce(sum(length(p.t)) OVER (PARTITION BY p_partkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM pieces),
marks AS (SELECT *, CASE WHEN form LIKE 'AUTHOR_YEAR%' THEN 'AUTHOR_YEAR' ELSE form END AS family FROM placed WHERE form <> '')"""


def _marked(spark, sf) -> DataFrame:
    p, size = table(spark, sf, "part"), F.col("p_size")
    text = F.concat(
        F.lit("As shown ["), size.cast("string"), F.lit("] and ["), size.cast("string"), F.lit("–"), (size + 2).cast("string"), F.lit(", 9]"), F.repeat(F.lit(" (see below)"), (F.col("p_partkey") % 3).cast("int")), F.lit(", "),
        F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 2), F.lit("ton and Lee ("), (size + 1950).cast("string"), F.lit("a) agreed (Fox et al. "), (size + 1950).cast("string"), F.lit(", 12; Lee 2012, 47). Table (2020) says so"),
        F.when(F.col("p_partkey") % 2 == 1, "¹²⁻¹⁴").otherwise(""), F.lit(" "), F.repeat(F.lit("other "), 25), F.lit("("), size.cast("string"), F.lit(", 5) too\n[Footnote] "), size.cast("string"), F.lit(". "), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("[note] "), F.col("p_name"))).otherwise(""),
    )
    return p.select("p_partkey", text.alias("text"))


@query("tvf07_markers", f"""
WITH {PIECES_SQL}
SELECT p_partkey, family, form, row_number() OVER (PARTITION BY p_partkey, family ORDER BY form = 'AUTHOR_YEAR_NARRATIVE', seq)::INTEGER AS place,
       CASE WHEN marker <> '' THEN marker WHEN form = 'NUMERIC_SUPERSCRIPT' THEN '¹²' ELSE t END AS marker, start,
       CASE WHEN form = 'NUMERIC_SUPERSCRIPT' THEN start + 2 ELSE start + length(t) END AS "end"
FROM marks UNION ALL
SELECT p_partkey, family, form, 2, '¹⁴', start + 3, start + 5 FROM marks WHERE form = 'NUMERIC_SUPERSCRIPT'""")
def tvf07_markers(spark, sf):
    """Markers of all six forms with their offsets; a superscript minus parts two of them."""
    return bibliographies.scan_markers(_marked(spark, sf), "p_partkey", "text").select("p_partkey", "family", "form", "place", "marker", "start", "end")


@query("ag24_styles", """
WITH c AS (SELECT p_partkey, 2::BIGINT AS NUMERIC_BRACKETED, 2::BIGINT AS AUTHOR_YEAR, (2 * (p_partkey % 2))::BIGINT AS NUMERIC_SUPERSCRIPT, 1::BIGINT AS NUMERIC_PARENTHETICAL, (1 + (p_partkey % 4 = 3)::INTEGER)::BIGINT AS FOOTNOTE_NOTE FROM part)
SELECT *, 'NUMERIC_BRACKETED' AS style FROM c""")
def ag24_styles(spark, sf):
    """Counts of the marker families of each text, and the dominant one by the order of ties."""
    return bibliographies.citation_styles(_marked(spark, sf), "p_partkey", "text")
