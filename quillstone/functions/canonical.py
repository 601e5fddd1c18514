"""Canonical JSON and its hashes: keys sorted at every level, no blanks, nulls kept (SC97-SC100)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a report that its hash leaves out.
UNHASHED = ("report_id", "report_hash", "report_version", "generated_at", "created_at", "generated_by")


def ordered(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the entries of its maps in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*[ordered(column[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))))
    return column


def canonical_json(column: Column, kind: T.DataType) -> Column:
    return F.to_json(ordered(column, kind), {"ignoreNullFields": "false"})


def content_hash(column: Column, kind: T.StructType, without: Iterable[str] = UNHASHED) -> Column:
    """Hash of a record without the fields that say nothing of its content."""
    kept = T.StructType([f for f in kind.fields if f.name not in set(without)])
    return F.sha2(canonical_json(F.struct(*[column[f.name].alias(f.name) for f in kept.fields]), kept), 256)


def manifest_hash(paths_and_hashes: Column) -> Column:
    """Hash of an array of (path, sha256), whatever its order: each path with its length before it."""
    parts = F.transform(F.array_sort(paths_and_hashes), lambda x: F.concat(F.lpad(F.octet_length(x["path"]).cast("string"), 8, "0"), x["path"], x["sha256"]))
    return F.sha2(F.array_join(parts, ""), 256)


def tampered(content: Column, recorded: Column) -> Column:
    """Whether a file is no longer what was recorded."""
    return F.sha2(content, 256) != recorded
