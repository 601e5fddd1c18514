"""Several tables written as one: readers see all of a version or none of it (DM13).

The tables of a version are written to a folder of their own. They are published by one file, the manifest, which is
renamed into its place under the next number; a rename to a name that is taken fails, so that of two writers one
wins. A writer that stops anywhere before leaves folders that no manifest names. Readers take the last manifest, or
the one they pinned, whose files never change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version in the meantime."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions, ascending."""
    fs, path = _files(spark, folder)
    at = path(f"{folder}/manifests")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, str]:
    """The paths of a version's tables by name: the last one's, or the given one's."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{folder} has no version {'' if version is None else version}")
    fs, path = _files(spark, folder)
    stream = fs.open(path(f"{folder}/manifests/{known[-1] if version is None else version:09}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the last version, or of a pinned one."""
    return spark.read.parquet(manifest(spark, folder, version)[name])


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], after: int | None = None) -> int:
    """Write ``tables`` as the next version, which keeps the tables of the last one that are not given; return its number.

    ``after`` is the version that the tables were made from; if another one was published since, nothing is. Of two
    writers that publish at once, one gets a ``Conflict``.
    """
    known = versions(spark, folder)
    last = known[-1] if known else 0
    if after is not None and after != last:
        raise Conflict(f"made from version {after}, but {last} is there")
    paths = manifest(spark, folder) if known else {}
    for name, df in tables.items():
        paths[name] = f"{folder}/tables/{name}/{uuid.uuid4().hex}"
        df.write.parquet(paths[name])
    fs, path = _files(spark, folder)
    fs.mkdirs(path(f"{folder}/manifests"))
    staged, final = path(f"{folder}/manifests/.{uuid.uuid4().hex}"), path(f"{folder}/manifests/{last + 1:09}.json")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(paths, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise Conflict(f"version {last + 1} was published by another writer")
    return last + 1
