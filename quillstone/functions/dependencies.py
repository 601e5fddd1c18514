"""Dependencies that environment files declare: requirement lines, conda, TOML, lock and setup files (TVF19, HL16, WN12).

Lines are read by expressions. TOML and INI, for which Spark has no reader, are turned into JSON one file at a
time in Arrow batches; everything after that is expressions again. A file that cannot be read declares nothing.
"""

from __future__ import annotations

import configparser
import json
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a requirement is written.
NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
BOUND = r"(?:===|==|~=|!=|<=|>=|<|>)\s*[^,;\s]+"
REQUIREMENT = rf"^({NAME})(?:\[([A-Za-z0-9_,.-]+)\])?\s*({BOUND}(?:\s*,\s*{BOUND})*)?\s*(?:;\s*([^;]+))?$"
DIRECT = rf"^({NAME})\s*@\s*(https?://\S+)$"
CONDA = rf"^({NAME})(?:=([^\s=]+)\S*)?$"
#: Files by how much they are trusted, most first; a file of another name comes at 12.
FILE_RANKS = (
    (r"^requirements\.txt$", 0), (r"^requirements.*\.txt$", 1), (r"^environment\.yml$", 2), (r"^environment\.yaml$", 3), (r"^pyproject\.toml$", 4), (r"^pipfile$", 5), (r"^pipfile\.lock$", 6),
    (r"^poetry\.lock$", 7), (r"^setup\.cfg$", 8), (r"^dockerfile$", 9), (r"^docker-compose\.ya?ml$", 10), (r"^setup\.py$", 14), (r"^readme", 13),
)

DEPENDENCY = "struct<name: string, version_constraint: string>"
ENTRIES = "array<struct<section: string, name: string, version_constraint: string, line: string>>"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _row(name: Column, constraint: Column) -> Column:
    return F.struct(name.alias("name"), constraint.alias("version_constraint")).cast(DEPENDENCY)


def requirement(line: Column) -> Column:
    """(name, constraint) of a requirement line; null for comments, options, bare links and what is none."""
    t = F.trim(F.substring_index(F.coalesce(line, F.lit("")), "#", 1))
    part = lambda k: F.regexp_extract(t, REQUIREMENT, k)
    extras = F.when(part(2) != "", F.concat(F.lit("["), part(2), F.lit("]"))).otherwise("")
    marker = F.when(part(4) != "", F.concat(F.lit("; "), F.trim(part(4)))).otherwise("")
    constraint = _some(F.concat(extras, F.regexp_replace(part(3), " ", ""), marker))
    linked = F.concat(F.lit("@ "), F.regexp_extract(t, DIRECT, 2))
    return F.when((t == "") | t.rlike(r"^(?:-|https?://|git\+)"), None).when(t.rlike(DIRECT), _row(F.regexp_extract(t, DIRECT, 1), linked)).when(t.rlike(REQUIREMENT), _row(part(1), constraint))


def requirements(content: Column) -> Column:
    """The dependencies of a requirements file, in order."""
    return F.array_compact(F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), requirement))


def conda_entry(value: Column) -> Column:
    """An entry of a conda environment: ``name=version=build``, or a requirement where it compares."""
    version = F.regexp_extract(value, CONDA, 2)
    pinned = F.when(version != "", F.concat(F.lit("=="), version))
    return F.when(value.rlike("==|[><~!]"), requirement(value)).when(value.rlike(CONDA), _row(F.regexp_extract(value, CONDA, 1), pinned))


def conda(content: Column) -> Column:
    """The dependencies of a conda environment file, those of its pip section too, in order.

    Indents say what belongs to ``dependencies:`` and what to ``pip:``; the lines of a file are folded in order.
    """
    kind = f"struct<top: int, pip: int, done: array<{DEPENDENCY}>>"
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^\s*[^#\s]"))
    none = F.lit(None).cast("int")
    nothing = F.lit(None).cast(DEPENDENCY)

    def step(acc: Column, line: Column) -> Column:
        word, indent = F.trim(line), F.length(line) - F.length(F.ltrim(line))
        value = F.trim(F.regexp_replace(word, r"^- ", ""))
        header, inside, entry = word == "dependencies:", acc["top"].isNotNull() & (indent > acc["top"]), word.startswith("- ")
        in_pip = acc["pip"].isNotNull() & (indent > acc["pip"])
        found = F.when(~inside | ~entry | header | (value == "pip:"), nothing).when(in_pip, requirement(value)).otherwise(conda_entry(value))
        top = F.when(header, indent).when(inside, acc["top"]).otherwise(none)
        pip = F.when(header | ~inside, none).when(entry & (value == "pip:"), indent).when(entry & ~in_pip, none).otherwise(acc["pip"])
        return F.struct(top.alias("top"), pip.alias("pip"), F.array_compact(F.concat(acc["done"], F.array(found))).alias("done")).cast(kind)

    start = F.struct(none.alias("top"), none.alias("pip"), F.array().cast(f"array<{DEPENDENCY}>").alias("done")).cast(kind)
    return F.aggregate(lines, start, step, lambda acc: acc["done"])


def _table(node: object, *path: str) -> dict:
    for step in path:
        node = node.get(step) if isinstance(node, dict) else None
    return node if isinstance(node, dict) else {}


def _pinned(section: str, values: dict) -> list[dict]:
    """``name = "constraint"`` and ``name = {version = ...}``; * is no constraint."""
    versions = ((n, v.get("version") if isinstance(v, dict) else v) for n, v in values.items())
    return [{"section": section, "name": n, "version_constraint": None if v == "*" else v} for n, v in versions if isinstance(v, str)]


def _lines(section: str, values: object) -> list[dict]:
    return [{"section": section, "line": v} for v in values if isinstance(v, str)] if isinstance(values, list) else []


def _pyproject(doc: dict) -> list[dict]:
    project, poetry = _table(doc, "project"), _table(doc, "tool", "poetry")
    python = project.get("requires-python")
    out = [{"section": "project", "name": "python", "version_constraint": python}] if isinstance(python, str) else []
    out += _lines("project", project.get("dependencies"))
    named = [(k, poetry.get(k)) for k in ("dependencies", "dev-dependencies")]
    named += [(f"group.{g}", _table(poetry, "group", g, "dependencies")) for g in _table(poetry, "group")]
    for section, values in named:
        out += _pinned(f"poetry.{section}", _table(values))
    return out + _lines("build-system", _table(doc, "build-system").get("requires"))


def _pipfile(doc: dict) -> list[dict]:
    wanted = _table(doc, "requires")
    python = wanted.get("python_version") or wanted.get("python_full_version")
    out = [{"section": "requires", "name": "python", "version_constraint": f"=={python}"}] if isinstance(python, str) else []
    return out + [x for s in ("packages", "dev-packages") for x in _pinned(s, _table(doc, s))]


def _poetry_lock(doc: dict) -> list[dict]:
    packages = doc.get("package")
    named = [p for p in packages if isinstance(p, dict) and isinstance(p.get("name"), str)] if isinstance(packages, list) else []
    return [{"section": "package", "name": p["name"], "version_constraint": f"=={p['version']}" if isinstance(p.get("version"), str) else None} for p in named]


def _pipfile_lock(doc: dict) -> list[dict]:
    return [x for s in ("default", "develop") for x in _pinned(s, _table(doc, s))]


def _setup_cfg(doc: dict) -> list[dict]:
    options = _table(doc, "options")
    python = (options.get("python_requires") or "").strip()
    out = [{"section": "options", "name": "python", "version_constraint": python}] if python else []
    return out + _lines("options", (options.get("install_requires") or "").splitlines())


def _ini(content: str) -> dict:
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(content)
    return {s: dict(parser.items(s)) for s in parser.sections()}


FORMATS = {
    "pyproject.toml": (tomllib.loads, _pyproject), "pipfile": (tomllib.loads, _pipfile), "pipfile.lock": (json.loads, _pipfile_lock),
    "poetry.lock": (tomllib.loads, _poetry_lock), "setup.cfg": (_ini, _setup_cfg),
}


def entries(content: Column, file: str) -> Column:
    """What a file of one of ``FORMATS`` declares, in order: array of (section, name, version_constraint, line)."""
    load, read = FORMATS[file]

    @F.pandas_udf(T.StringType())
    def run(files: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            try:
                doc = load(text or "")
            except (ValueError, configparser.Error):
                return "[]"
            return json.dumps(read(doc) if isinstance(doc, dict) else [])

        return files.map(one, na_action=None)

    return F.from_json(run(content), ENTRIES)


def declared(content: Column, file: str) -> Column:
    """(name, constraint) of every dependency that a file of one of ``FORMATS`` declares; its requirement lines are parsed."""
    return F.array_compact(F.transform(entries(content, file), lambda e: F.when(e["name"].isNotNull(), _row(e["name"], e["version_constraint"])).otherwise(requirement(e["line"]))))


def file_rank(path: Column) -> Column:
    """How early an environment file is read, by its name."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = None
    for pattern, rank in FILE_RANKS:
        out = F.when(name.rlike(pattern), rank) if out is None else out.when(name.rlike(pattern), rank)
    return out.otherwise(12)
