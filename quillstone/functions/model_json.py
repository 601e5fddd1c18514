"""JSON in what language models answer: alone, in a fence, or somewhere in the text (SC96)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a fenced block.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
#: The pieces of a text that tell where an object ends: an escape, a quote, a brace, and what lies between.
PIECES = r"(\\[\s\S]|[\"{}]|[^\\\"{}]+|\\)"


def first_object(text: Column) -> Column:
    """The text from the first brace to the one that closes it, or null. Braces in strings do not count."""
    tail = F.substring(text, F.greatest(F.lit(1), F.instr(text, "{")), F.length(text))
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        quoted = F.when(piece == '"', ~a["quoted"]).otherwise(a["quoted"])
        depth = a["depth"] + F.when(~a["quoted"] & (piece == "{"), 1).when(~a["quoted"] & (piece == "}"), -1).otherwise(0)
        done = ~a["quoted"] & (piece == "}") & (depth == 0)
        return F.when(a["done"], a).otherwise(F.struct(quoted.alias("quoted"), depth.alias("depth"), (a["n"] + F.length(piece)).alias("n"), done.alias("done")))

    found = F.aggregate(F.regexp_extract_all(tail, F.lit(PIECES), F.lit(1)), start, step)
    return F.when((F.instr(text, "{") > 0) & found["done"], F.substring(tail, F.lit(1), found["n"]))


def tolerant_json(text: Column) -> Column:
    """The JSON that an answer holds, as VARIANT: the whole of it, else the first fence, else the first object; or null.

    Texts are read whole, in one pass for each try; null and blank ones hold none.
    """
    whole = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "^﻿+", "")
    fenced = F.regexp_replace(F.regexp_extract(whole, FENCE, 1), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.try_parse_json(F.nullif(whole, F.lit(""))), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(first_object(whole)))
