"""Greedy fuzzy clustering of near-equal statements (WN08)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.fuzzy import ratio, token_set

#: An experiment's fields that may not conflict, those of which one must be shared, those that are merged.
COMPARED = ("dataset", "split", "model", "metric", "reported_result")
IDENTITY = ("dataset", "model", "metric")
MERGED = ("dataset", "split", "model", "metric", "baseline", "reported_result")
#: A setting that tells experiments of one wording apart.
IMAGES = r"(?i)\b(\d+)\s+images?\s*(?:/|per)\s*class\b"


def claim_clusters(claims: DataFrame, block: list[str], order: str, text: str, least: float = 96.0) -> DataFrame:
    """Each claim with the order value of the cluster's first claim, in encounter order.

    Only claims that agree in ``block`` (paper, metric, value) can be one, so each block is small; texts that
    are equal after case and white space are joined before, by key. A claim joins the first cluster whose
    first text has a ratio of ``least`` or more.
    """
    form = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    rows = claims.withColumn("__form", form)
    distinct = rows.groupBy(*block, "__form").agg(F.min(order).alias("__first"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[str, int]] = []
        out = []
        for t, at in pdf.sort_values("__first")[["__form", "__first"]].itertuples(index=False):
            # A ratio cannot reach the limit where the lengths alone differ too much.
            head = next((h for s, h in heads if 200 * min(len(s), len(t)) >= least * (len(s) + len(t)) and ratio(s, t) >= least), None)
            if head is None:
                heads.append((t, at))
                head = at
            out.append((t, head))
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in block}, "__form": [t for t, _ in out], "cluster": [h for _, h in out]})[[*block, "__form", "cluster"]]

    kinds = dict(distinct.dtypes)
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in block) + f", __form string, cluster {kinds['__first']}"
    return rows.join(distinct.groupBy(*block).applyInPandas(greedy, schema), [*block, "__form"]).drop("__form")


def plain(text: object) -> str:
    """Lower-case letters and digits of a value, other characters as one space; missing values are empty."""
    return "" if text is None else re.sub(r"[^a-z0-9]+", " ", str(text).casefold()).strip()


def experiment_clusters(experiments: DataFrame, paper: str, order: str, least: float = 92.0) -> DataFrame:
    """One row for each experiment that stays: paper, cluster (the first one's order), n, objective and the fields.

    ``experiments`` has the fields of MERGED as strings and an objective. An experiment joins the first one before
    it whose fields do not conflict, with a shared identity, the same images a class and a wording of ``least`` or
    more; it fills that one's missing fields and lends it the longer objective. The order matters, as each merged
    experiment is compared as it has become, so a paper's distinct experiments are folded in one group; equal rows
    are counted before, at the place of their first, so that copies cannot fill a group: a plain fold could tell
    a later copy apart once the merged wording has moved away from it. Of equal rows, and equal orders, the first by order and then by fields counts.
    """
    values = ["objective", *MERGED]
    # Equal rows fall together whenever one identity field is there; rows without any stay apart.
    lone = F.when(F.coalesce(*IDENTITY).isNull(), F.col(order))
    distinct = experiments.groupBy(paper, *values, lone.alias("__lone")).agg(F.min(order).alias("cluster"), F.count("*").alias("n")).drop("__lone")

    def same(a: dict, b: dict, text_a: str, text_b: str) -> bool:
        both = [f for f in COMPARED if a[f] is not None and b[f] is not None]
        images = [re.search(IMAGES, r["objective"] or "") for r in (a, b)]
        if not any(f in IDENTITY for f in both) or any(plain(a[f]) != plain(b[f]) for f in both):
            return False
        if all(images) and images[0][1] != images[1][1]:
            return False
        return text_a == text_b or token_set(text_a, text_b) >= least

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        heads: list[tuple[dict, str]] = []
        for row in sorted(rows, key=lambda r: (r["cluster"], *[(r[v] is not None, r[v] or "") for v in values])):
            text = plain(row["objective"])
            at = next((i for i, (head, form) in enumerate(heads) if same(head, row, form, text)), None)
            if at is None:
                heads.append((row, text))
                continue
            head = heads[at][0]
            longest = max(head["objective"] or "", row["objective"] or "", key=len) or head["objective"]
            merged = head | {f: row[f] for f in MERGED if head[f] is None} | {"n": head["n"] + row["n"], "objective": longest}
            heads[at] = (merged, plain(longest))
        return pd.DataFrame([h for h, _ in heads], columns=pdf.columns)

    return distinct.groupBy(paper).applyInPandas(fold, distinct.schema)
