"""What URLs, files and headings are, as tables of ordered patterns turned into one expression (SC69-SC80, F16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that the text matches."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


#: Hosts of papers, which are no artifacts.
PAPER_HOSTS = ("arxiv.org", "www.arxiv.org", "aclanthology.org", "www.aclanthology.org", "doi.org", "www.doi.org", "dl.acm.org", "ieeexplore.ieee.org", "proceedings.mlr.press", "neurips.cc")
#: File names of an artifact's URL by type.
URL_FILES = (
    ("DEPENDENCY", r"^(requirements\.txt|pyproject\.toml|setup\.py|environment\.ya?ml|package\.json)$"),
    ("CONTAINER", r"^(dockerfile|docker-compose\.ya?ml)$"),
    ("EXECUTION_SCRIPT", r"\.(sh|bash)$|^(train|evaluate|eval|run)\.py$"),
)
CONFIG_FILE, CHECKPOINT_FILE = r"\.(yaml|yml|toml|ini|cfg|json)$", r"\.(ckpt|pth|pt|safetensors|bin)$"
#: Wording near a URL by type.
URL_CONTEXT = (
    ("DATASET", r"(?i)\b(dataset|corpus|benchmark data)\b"), ("MODEL", r"(?i)\b(model weights?|pretrained model|checkpoint)\b"),
    ("SUPPLEMENTARY", r"(?i)\b(supplementary|supplemental|appendix material)\b"), ("CODE", r"(?i)\b(source code|code (?:is )?available|implementation|repository)\b"),
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def url_type(url: Column, around: Column) -> Column:
    """The type of the artifact behind a URL, or null for papers and what nothing speaks for."""
    from quillstone.functions.identifiers import repository

    low = F.lower(F.concat_ws(" ", url, around))
    name = F.lower(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1))
    by_context = first_rule(around, URL_CONTEXT)
    named = first_rule(name, URL_FILES)
    return (
        F.when(host(url).isin(*PAPER_HOSTS), None)
        .when(named.isNotNull(), named)
        .when(low.contains("hub.docker.com"), "CONTAINER")
        .when(name.rlike(CONFIG_FILE) & ~low.contains("dataset"), "CONFIG")
        .when(name.rlike(CHECKPOINT_FILE), "CHECKPOINT")
        .when(repository(url).isNotNull(), "CODE")
        .when(low.rlike(r"(huggingface\.co|kaggle\.com)/datasets/") | (by_context == "DATASET"), "DATASET")
        .when(low.contains("huggingface.co/"), "MODEL")
        .otherwise(by_context)
    )


#: Repository files by name, in order: type, then role.
FILE_TYPES = (
    ("DEPENDENCY", r"^(requirements[^/]*\.txt|pyproject\.toml|setup\.(py|cfg)|environment\.ya?ml|pipfile(\.lock)?|poetry\.lock|package\.json|conda\.ya?ml)$"),
    ("CONTAINER", r"^(dockerfile|docker-compose\.ya?ml|containerfile)$"), ("MAKEFILE", r"^(makefile|justfile)$"), ("CHECKPOINT", r"\.(ckpt|pth|pt|safetensors|bin|h5|onnx)$"),
    ("CONFIG", r"\.(ya?ml|toml|ini|cfg|json)$"), ("DOCUMENTATION", r"\.(md|rst|txt)$|^readme"), ("PYTHON", r"\.py$"), ("NOTEBOOK", r"\.ipynb$"), ("JAVASCRIPT", r"\.js$"), ("TYPESCRIPT", r"\.ts$"),
    ("CPP", r"\.(cpp|cc|cxx)$"), ("JAVA", r"\.java$"), ("GO", r"\.go$"), ("RUST", r"\.rs$"), ("SHELL", r"\.(sh|bash)$"),
)
FIXED_ROLES = {"DEPENDENCY": "DEPENDENCY", "CONTAINER": "CONFIGURATION", "MAKEFILE": "EXECUTION_SCRIPT", "CHECKPOINT": "CHECKPOINT", "CONFIG": "CONFIGURATION", "DOCUMENTATION": "DOCUMENTATION"}
FILE_ROLES = (
    ("DATA_PREPARATION", r"download.*checkpoint|checkpoint.*download"), ("TRAINING", r"(?:^|[/_\- ])train(?:$|[/_\- ])|finetun|fine[_-]?tun"), ("EVALUATION", r"eval|benchmark"), ("INFERENCE", r"infer|predict|demo"),
    ("DATA_PREPARATION", r"(?:^|[/ ])data$|prepare|dataset|data[_-]?prep"), ("MODEL_DEFINITION", r"model|network|architecture"), ("PREPROCESSING", r"token|preprocess"), ("POSTPROCESSING", r"postprocess"),
)


def file_kind(path: Column) -> Column:
    """(type, role) of a repository's file by its path."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    kind = first_rule(name, FILE_TYPES, "OTHER")
    stem = F.concat_ws(" ", F.lower(F.regexp_replace(path, r"/?[^/]*$", "")), F.regexp_replace(name, r"\.[^.]*$", ""))
    fixed = F.create_map(*[F.lit(x) for kv in FIXED_ROLES.items() for x in kv])
    return F.struct(kind.alias("file_type"), F.coalesce(F.try_element_at(fixed, kind), first_rule(stem, FILE_ROLES, "UNKNOWN")).alias("role"))


#: Sections by the words of their headings, in order.
SECTIONS = (
    ("ABSTRACT", r"^(abstract|summary)$"), ("INTRODUCTION", r"\bintroduction\b"), ("RELATED_WORK", r"^(prior work|literature review)$|\brelated\b.*\bwork\b|\bwork\b.*\brelated\b"), ("BACKGROUND", r"\bbackground\b"),
    ("METHODOLOGY", r"\bmethodology\b"), ("METHODS", r"\bdataset\b.*\bcondensation\b"), ("MODEL", r"\b(architecture|model|training)\b"), ("DATASET", r"\bdatasets?\b"), ("DATA", r"\bdata\b"),
    ("EXPERIMENTAL_SETUP", r"\bexperiment(al)?\b.*\bsetup\b"), ("EXPERIMENTS", r"\bexperiments?\b"), ("EVALUATION", r"\bevaluations?\b"), ("RESULTS", r"\bresults?\b"), ("DISCUSSION", r"\bdiscussion\b"),
    ("CONCLUSION", r"\bconclusions?\b"), ("LIMITATIONS", r"\blimitations?\b"), ("APPENDIX", r"\bappendi(x|ces)\b"), ("REFERENCES", r"\b(references|bibliography)\b|^(works cited|reference list)$"), ("METHODS", r"\b(methods?|approach|procedure)\b"),
)


def section_type(heading: Column) -> Column:
    """The kind of section that a heading starts."""
    plain = F.regexp_replace(heading, r"(?i)^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)\.?\s+", "")
    return first_rule(F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " ")), SECTIONS, "OTHER")


def expected_roles(model: Column, dataset: Column) -> Column:
    """Roles of files that an experiment needs."""
    always = [F.lit(r) for r in ("EVALUATION", "DEPENDENCY", "CONFIGURATION", "CHECKPOINT")]
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(F.array(*always, F.when(said(model), "MODEL_DEFINITION"), F.when(said(dataset), "DATA_PREPARATION")))


def file_readiness(relevant: Column, possible: Column, missing: Column, accessible: Column) -> Column:
    """How ready an artifact's files are, from their counts."""
    return F.when(~accessible, "MISSING").when((relevant > 0) & (missing == 0), "COMPLETE").when(relevant > 0, "PARTIAL").when(possible > 0, "LIMITED").otherwise("UNKNOWN")


def plan_status(blocking: Column, missing: Column, conflicts: Column, steps: Column) -> Column:
    """Status of a plan from its numbers of issues and steps."""
    return F.when(blocking > 0, "BLOCKED").when(steps == 0, "UNKNOWN").when((missing > 0) | (conflicts > 0), "PARTIALLY_READY").otherwise("READY_FOR_EXECUTION")


def environment_status(facts: Column, conflicts: Column, missing: Column, accessible: Column) -> Column:
    return F.when(~accessible, "BLOCKED").when(facts == 0, "UNKNOWN").when((conflicts == 0) & (missing == 0), "RECONSTRUCTED").otherwise("PARTIALLY_RECONSTRUCTED")


def atomic_result(metric: Column, model: Column) -> Column:
    """Whether a result has one metric and one model, not several or a class of them."""
    one_metric = (F.coalesce(metric, F.lit("")) != "") & ~metric.rlike(r" [/|] ")
    one_model = (F.coalesce(model, F.lit("")) != "") & ~F.lower(model).rlike(r"\b(various|several|multiple|all|models|baselines)\b| and |, |\d+\s*[-–]\s*\d+")
    return one_metric & one_model


def option_text(command: Column, name: str) -> Column:
    """The value of ``--name value`` or ``--name=value``, '' where there is none."""
    return F.regexp_extract(command, rf"(?:^|\s)--{name}(?:=|\s+)([^\s]+)", 1)


def option(command: Column, name: str) -> Column:
    """The value of ``--name value`` or ``--name=value``."""
    return F.nullif(option_text(command, name), F.lit(""))


def allowed_command(command: Column, files: Column) -> Column:
    """Whether a command runs a known relative Python script and nothing else."""
    script = F.regexp_extract(command, r"^\s*python3?\s+([^\s]+\.py)(?:\s|$)", 1)
    return (script != "") & ~script.rlike(r"^/|(^|/)\.\.(/|$)") & ~command.rlike(r"[;&|<>$`\\\n]") & F.array_contains(files, script)


#: Files and folders that may not be staged.
UNSTAGED = (".env", ".git", ".ssh", ".aws", ".azure", ".config/gcloud", "id_rsa", "id_ed25519", "credentials", "credentials.json")


def staging_fault(path: Column, symlink: Column) -> Column:
    """Why a file may not be staged: a forbidden name or folder at its root, or a symbolic link; null if it may."""
    p = F.lower(path)
    forbidden = p.isin(*UNSTAGED)
    for name in UNSTAGED:
        forbidden = forbidden | p.startswith(f"{name}/")
    return F.when(forbidden, "INVALID_TARGET").when(F.coalesce(symlink, F.lit(False)), "ARTIFACT_CHANGED")
