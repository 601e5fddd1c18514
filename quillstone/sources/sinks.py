"""Writing results: CSV with a fixed order, summaries, review queues, sheets, pages (SNK01-SNK14)."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_ROWS = 20_000


def write_csv(df: DataFrame, path: str, files: int | None = None) -> bool:
    """CSV with a header; nothing is written for no rows. ``files`` limits their number for small results."""
    if df.isEmpty():
        return False
    flat = df.select(*[F.array_join(F.col(c), "; ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(files) if files else flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def summary(kpis: DataFrame) -> DataFrame:
    """A one-row frame as (metric, value) rows."""
    return kpis.select(*[F.col(c).cast("string").alias(c) for c in kpis.columns]).unpivot([], kpis.columns, "metric", "value")


def sheets(refs: DataFrame, documents: DataFrame, kpis: DataFrame) -> dict[str, DataFrame]:
    """The parts of a workbook; those without rows are for the writer to leave out."""
    return {
        "Summary": summary(kpis), "Documents": documents, "All_References": refs,
        "Human_Review": refs.filter("needs_human_review"), "Wrong_DOI_Cases": refs.filter("final_status = 'VALID_DOI_WRONG_REFERENCE'"),
    }


def write_sheets(parts: dict[str, DataFrame], path: str) -> list[str]:
    """One CSV folder for each part that has rows; control characters become blanks."""
    done = []
    for name, df in parts.items():
        clean = df.select(*[F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        if write_csv(clean, f"{path}/{name}", files=1):
            done.append(name)
    return done


def all_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames under the ordered union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def export(df: DataFrame, order: list, most: int = EXPORT_ROWS) -> DataFrame:
    """The rows of a filtered export, in order, at most ``most``: the size is the feature."""
    return df.orderBy(*order).limit(most)


def page(title: str, rows: list[dict], most: int = 200) -> str:
    """A small script-free page of rows already limited by a query."""
    head = list(rows[0]) if rows else []
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in head) + "</tr>" for r in rows[:most])
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in head)}</tr>{body}</table>"


def backfill(rows: DataFrame, meta: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose ``column`` is empty get it from ``meta``; others keep theirs."""
    m = meta.select(key, F.col(column).alias("__new"))
    return rows.join(m, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("__new"), F.lit(""))).drop("__new")
