"""Artifacts that papers name, and the files of their repositories by experiment (TVF16, TVF17, TVF18, TVF28).

Candidates come as four streams: links in the text, files that linked repositories show, data sets and models that
experiments name, mentions of something without a link. They are one table with an order, of which the first of each
identity is kept. What is known of repositories is a table that is joined. Nothing is fetched or run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import artifacts as kinds
from quillstone.functions import identifiers
from quillstone.functions.fuzzy import token_set_ratio
from quillstone.functions.spread import spread
from quillstone.functions.text import around, located
from quillstone.operators.case_graph import kept
from quillstone.operators.matching import associated

#: Links, also those that a line end cuts after a slash, and what does not end one.
URL = r"""(?i)(?:(?:https?://|www\.)[^\s<>{}\[\]"']+|(?<![\w./])(?:github|gitlab)\.com/[^\s<>{}\[\]"']+)(?:(?<=/)[ \t]*\r?\n[ \t]*[A-Za-z0-9][A-Za-z0-9._~!$&'()*+,;=:@%/-]*)*"""
WRAP, TRAILING = r"(?<=/)[ \t]*\r?\n[ \t]*", r"""[.,;:!?)\]}>'"]+$"""
REPOSITORY_HOSTS = ("github.com", "www.github.com", "gitlab.com", "www.gitlab.com")
HEADING, HEADINGS = r"^\d+(?:\.\d+)*\s+[A-Z][A-Za-z0-9 ,:&\-/]{2,70}$", ("abstract", "introduction", "methods", "experiments", "results", "discussion", "conclusion", "appendix")
CONTEXT = 240
#: Types of the files that a repository shows, mentions without a link.
SHOWN_FILES = (
    ("DEPENDENCY", r"^(requirements\.txt|pyproject\.toml|setup\.py|environment\.ya?ml|package\.json|package-lock\.json|poetry\.lock)$"), ("CONTAINER", r"^(dockerfile|docker-compose\.ya?ml)$"),
    ("CONFIG", r"\.(yaml|yml|toml|ini|cfg)$|config"), ("EXECUTION_SCRIPT", r"\.(sh|bash)$|^(train|evaluate|eval|run)\.py$"), ("CHECKPOINT", r"\.(ckpt|pth|pt|safetensors)$"),
)
MENTIONS = (
    ("CODE", r"\b(?:source )?code (?:is |will be )?available\b", "Code availability is mentioned without an identifiable public URL."),
    ("SUPPLEMENTARY", r"\b(?:supplementary|supplemental) material\b", "Supplementary material is mentioned without an identifiable public URL."),
)
OFFICIAL, DOUBTFUL = r"(?i)\b(official|our)\s+(?:code|implementation|repository)\b", r"(?i)\b(unofficial|possible|mirror|related repository)\b"

CANDIDATE = ("experiment_id", "type", "name", "source", "source_url", "repository", "discovery_method", "evidence_location", "relationship_status", "availability_status", "confidence", "version", "notes")


def public_url(raw: Column) -> Column:
    """A link in canonical form, with a scheme and without what follows it in a sentence; null for no web address."""
    bare = F.regexp_replace(F.regexp_replace(raw, WRAP, ""), TRAILING, "")
    full = F.when(bare.rlike(r"(?i)^(?:(?:github|gitlab)\.com/|www\.)"), F.concat(F.lit("https://"), bare)).otherwise(bare)
    return F.when(full.rlike(r"(?i)^https?://[^/?#\s]"), identifiers.canonical_url(full))


def repository_url(url: Column) -> Column:
    """The address of a repository of a known host, whatever page of it is meant; null for others."""
    found = identifiers.repository(url)
    host = F.when(found["platform"] == "github", "github.com").otherwise("gitlab.com")
    return F.when(kinds.host(url).isin(*REPOSITORY_HOSTS) & found.isNotNull(), F.concat(F.lit("https://"), host, F.lit("/"), found["owner"], F.lit("/"), found["name"]))


def nearest_heading(before: Column) -> Column:
    """The last line of a text that reads as a heading, or null."""
    lines = F.transform(F.split(before, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    fits = F.filter(lines, lambda x: (x.rlike(HEADING) | F.lower(x).isin(*HEADINGS)) & (F.size(F.split(x, " ")) <= 10))
    return F.try_element_at(fits, F.lit(-1))


def links(papers: DataFrame) -> DataFrame:
    """One row per link of each paper's text: case_id, url, context, location, place (its start in the text)."""
    text = F.coalesce("text", F.lit(""))
    found = F.transform(located(text, URL), lambda m: F.struct(public_url(m["whole"]).alias("url"), around(text, m["start"], m["end"], CONTEXT).alias("context"), nearest_heading(F.substr(text, F.lit(1), m["start"])).alias("location"), m["start"].alias("place")))
    # The outer form: of an inner one the optimizer finds all links once more, to see whether there are any.
    return spread(papers.select("case_id", "text")).select("case_id", F.explode_outer(F.filter(found, lambda x: x["url"].isNotNull())).alias("x")).filter("x is not null").select("case_id", "x.*")


def _key() -> Column:
    """The identity of a candidate: a repository, a link, or what an experiment names."""
    by = F.when((F.col("type") == "CODE") & F.col("repository").isNotNull(), F.lower("repository")).when(F.col("source_url").isNotNull(), F.lower("source_url"))
    return F.coalesce(by, F.lower(F.concat(F.coalesce("experiment_id", F.lit("None")), F.lit(":"), F.coalesce("name", F.lit("None")))))


def _kept_first(candidates: DataFrame) -> DataFrame:
    rest = [c for c in candidates.columns if c not in ("case_id", "key", "type")]
    first = candidates.withColumn("key", _key()).groupBy("case_id", "type", "key").agg(F.min_by(F.struct(*rest), F.struct("stage", "at")).alias("r"))
    return first.select("case_id", "type", "r.*")


def discover(papers: DataFrame, experiments: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row per artifact of each case, numbered in the order in which it is found.

    ``papers`` has case_id, text, title and authors (an array); ``experiments`` case_id, experiment_id, place (their
    order), objective, dataset, model and evidence_locations; ``repositories`` what is known of each canonical_url:
    platform, name, accessible, description, readme, visible_files, default_branch and license_name. A repository that
    is not known counts as inaccessible. Null and empty texts have no links. A case_id should be unique in ``papers``.
    """
    found = links(papers).withColumn("repository", repository_url(F.col("url"))).withColumn("type", kinds.url_type(F.col("url"), F.col("context"))).filter("type is not null")
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/?#]+/?|[?#].*$", ""), "/+$", "")
    plain = F.translate(F.substring_index(path, "/", -1), "-_", "  ")
    named = F.when(F.col("repository").isNotNull(), F.substring_index("repository", "/", -1)).when(path != "", plain).otherwise(kinds.host(F.col("url")))
    url, none = F.coalesce("repository", "url"), F.lit(None).cast("string")
    source = F.coalesce(identifiers.repository(F.col("repository"))["platform"], kinds.host(F.col("url")))
    found = associated(found, experiments, "case_id", "context", "experiment_id", "place", ["dataset", "model"]) if experiments is not None else found.withColumn("experiment_id", none)
    linked = found.select(
        "case_id", F.lit(0).alias("stage"), F.array(F.col("place").cast("long")).alias("at"), "experiment_id", "type", named.alias("name"), source.alias("source"), url.alias("source_url"), "repository",
        F.when(F.col("type") == "SUPPLEMENTARY", "SUPPLEMENTARY_LINK").otherwise("PAPER_URL").alias("discovery_method"), F.col("location").alias("evidence_location"), "context",
    )
    # Written once: links and what they say are read by several branches below, and so are the artifacts seen.
    linked = kept(_kept_first(linked))
    known = repositories.select(F.col("canonical_url").alias("repository"), F.struct(*[c for c in repositories.columns]).alias("m"))
    titled = papers.select("case_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))
    code = linked.filter("type = 'CODE' and repository is not null").join(known, "repository", "left").join(titled, "case_id")
    m, context = F.col("m"), F.coalesce("context", F.lit(""))
    said = F.concat_ws(" ", F.nullif(m["description"], F.lit("")), F.nullif(m["readme"], F.lit("")))
    code = code.withColumn("said", said).withColumn("same_title", (F.col("title") != "") & (F.col("said") != "") & (token_set_ratio(F.when((F.col("title") != "") & (F.col("said") != ""), F.col("title")), F.col("said")) >= 90))
    open_ = F.coalesce(m["accessible"], F.lit(False))
    official, doubtful, same = context.rlike(OFFICIAL), context.rlike(DOUBTFUL), F.coalesce("same_title", F.lit(False))
    named_author = F.exists("authors", lambda x: F.contains(F.lower("said"), F.lower(F.element_at(F.split(F.trim(x), r"\s+"), -1))) & (F.trim(x) != ""))
    relation = F.when(~open_, "PARTIAL").when(doubtful, "AMBIGUOUS").when(same | official, "VERIFIED").otherwise("FOUND")
    sure = F.when(~open_ | doubtful, "LOW").when(same | official, "HIGH").otherwise("MEDIUM")
    note = (
        F.when(~open_, "Repository availability could not be confirmed.").when(doubtful, "The paper context does not establish an official relationship.")
        .when(same & (named_author | official), "Paper title and authors/official wording match repository text.").when(same | official, "Direct paper link and repository text strongly establish identity.")
        .otherwise("Repository was explicitly linked, but its paper relationship is not fully verified.")
    )
    license_ = F.when(open_ & (F.coalesce(m["license_name"], F.lit("")) != ""), F.concat(F.lit("Visible license: "), m["license_name"], F.lit(".")))
    base = ["case_id", "stage", "at", "experiment_id", "type"]
    code = code.select(
        *base, F.coalesce(m["name"], "name").alias("name"), F.coalesce(m["platform"], "source").alias("source"), "source_url", "repository", "discovery_method", "evidence_location", relation.alias("relationship_status"),
        F.when(open_, "FOUND").otherwise("INACCESSIBLE").alias("availability_status"), sure.alias("confidence"), F.when(open_, m["default_branch"]).alias("version"), F.array_compact(F.array(note, license_)).alias("notes"), "m",
    )
    others = linked.filter("type <> 'CODE' or repository is null").select(*base, "name", "source", "source_url", "repository", "discovery_method", "evidence_location", F.lit("FOUND").alias("relationship_status"), F.lit("FOUND").alias("availability_status"), F.lit("MEDIUM").alias("confidence"), none.alias("version"), F.array().cast("array<string>").alias("notes"))
    shown = code.filter("availability_status = 'FOUND'").select("*", F.posexplode("m.visible_files").alias("k", "file")).withColumn("child", kinds.first_rule(F.lower("file"), SHOWN_FILES)).filter("child is not null")
    branch = F.coalesce(F.nullif(m["default_branch"], F.lit("")), F.lit("HEAD"))
    quoted = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    page = F.concat(F.col("repository"), F.lit("/blob/"), F.replace(quoted(branch), F.lit("%2F"), F.lit("/")), F.lit("/"), F.replace(quoted(F.col("file")), F.lit("%2F"), F.lit("/")))
    verified = F.col("relationship_status") == "VERIFIED"
    shown = shown.select(
        "case_id", F.lit(1).alias("stage"), F.concat("at", F.array(F.col("k").cast("long"))).alias("at"), "experiment_id", F.col("child").alias("type"), F.col("file").alias("name"), "source", page.alias("source_url"), "repository",
        F.lit("PUBLIC_REPOSITORY_LOOKUP").alias("discovery_method"), "evidence_location", F.when(verified, "VERIFIED").otherwise("PARTIAL").alias("relationship_status"), F.lit("FOUND").alias("availability_status"),
        F.when(verified, "HIGH").otherwise("MEDIUM").alias("confidence"), m["default_branch"].alias("version"), F.array(F.lit("File presence was inspected as metadata only; it was not downloaded or executed.")).alias("notes"),
    )
    seen = kept(code.drop("m").unionByName(others).unionByName(shown))

    expects = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).alias("type"), F.col(c).alias("name"), F.lit(f"{t}_MENTION").alias("method")) for k, (t, c) in enumerate((("DATASET", "dataset"), ("MODEL", "model")))])
    expected = experiments.select("case_id", "experiment_id", "place", "evidence_locations", F.explode(expects).alias("x")).filter("coalesce(x.name, '') <> ''").select("case_id", "experiment_id", "place", "evidence_locations", "x.*")
    expected = expected.join(seen.filter("experiment_id is not null").select("case_id", "experiment_id", "type").distinct(), ["case_id", "experiment_id", "type"], "left_anti")
    expected = expected.select(
        "case_id", F.lit(2).alias("stage"), F.array(F.col("place").cast("long"), "k").alias("at"), "experiment_id", "type", "name", none.alias("source"), none.alias("source_url"), none.alias("repository"), F.col("method").alias("discovery_method"), F.get("evidence_locations", F.lit(0)).alias("evidence_location"),
        F.lit("PARTIAL").alias("relationship_status"), F.lit("MISSING").alias("availability_status"), F.lit("HIGH").alias("confidence"), none.alias("version"), F.array(F.lit("The experiment names this artifact, but no exact public URL/version was established.")).alias("notes"),
    )
    mentions = F.array(*[F.when(F.lower("text").rlike(p), F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).alias("type"), F.lit(n).alias("note"))) for k, (t, p, n) in enumerate(MENTIONS)])
    mentioned = papers.select("case_id", F.explode(F.array_compact(mentions)).alias("x")).select("case_id", "x.*")
    mentioned = mentioned.join(seen.select("case_id", "type").distinct(), ["case_id", "type"], "left_anti").select(
        "case_id", F.lit(3).alias("stage"), F.array("k").alias("at"), none.alias("experiment_id"), "type", none.alias("name"), none.alias("source"), none.alias("source_url"), none.alias("repository"), F.lit("PAPER_TEXT").alias("discovery_method"), none.alias("evidence_location"),
        F.lit("PARTIAL").alias("relationship_status"), F.lit("MISSING").alias("availability_status"), F.lit("MEDIUM").alias("confidence"), none.alias("version"), F.array("note").alias("notes"),
    )
    first = _kept_first(seen.unionByName(expected).unionByName(mentioned))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("stage", "at", "type"))
    return first.select("case_id", F.format_string("ART-%03d", number).alias("artifact_id"), *CANDIDATE)


#: Repository files by name, extension and the words of their paths, in order.
FILE_TYPES = (
    ("DEPENDENCY", r"^(requirements\.txt|environment\.ya?ml|pyproject\.toml|setup\.py|setup\.cfg|pipfile|package\.json|poetry\.lock)$"), ("CONTAINER", r"^(dockerfile|docker-compose\.ya?ml)$"), ("MAKEFILE", r"^(makefile|justfile)$"),
    ("CHECKPOINT", r"\.(pt|pth|bin|ckpt|safetensors)$"), ("CONFIG", r"\.(yaml|yml|json|toml|ini|cfg|conf)$"), ("DOCUMENTATION", r"\.(md|rst|txt)$|^readme"), ("PYTHON", r"\.py$"), ("NOTEBOOK", r"\.ipynb$"),
    ("JAVASCRIPT", r"\.js$"), ("TYPESCRIPT", r"\.ts$"), ("CPP", r"\.(cpp|cc|cxx)$"), ("JAVA", r"\.java$"), ("GO", r"\.go$"), ("RUST", r"\.rs$"), ("SHELL", r"\.(sh|bash)$"),
)
ROLES_OF_TYPES = {"DEPENDENCY": "DEPENDENCY", "CONTAINER": "CONFIGURATION", "MAKEFILE": "EXECUTION_SCRIPT", "CHECKPOINT": "CHECKPOINT", "CONFIG": "CONFIGURATION", "DOCUMENTATION": "DOCUMENTATION"}
PATH_ROLES = (
    ("DATA_PREPARATION", r"download.*checkpoint|checkpoint.*download"), ("TRAINING", r"(?:^|[/_\- ])train(?:$|[/_\- ])|finetun|fine[_-]?tun"), ("EVALUATION", r"eval|benchmark"), ("INFERENCE", r"infer|predict|demo"),
    ("DATA_PREPARATION", r" data$|prepare|dataset|data[_-]?prep"), ("MODEL_DEFINITION", r"model|network|architecture"), ("PREPROCESSING", r"token|preprocess"), ("POSTPROCESSING", r"postprocess"), ("METRIC", r"metric|score"),
    ("ENTRYPOINT", r"(?:^|[/_\- ])(?:run|main|cli)(?:$|[/_\- ])"),
)
NO_TERMS = ("and", "baseline", "dataset", "evaluate", "evaluation", "experiment", "for", "metric", "model", "on", "task", "test", "the", "train", "training", "using", "fine", "tune", "tuning", "performance", "results", "analysis", "with")
QUALIFIERS = ("base", "large", "medium", "small", "tiny", "xxl", "xl")
WORKING_ROLES = ("TRAINING", "EVALUATION", "INFERENCE", "DATA_PREPARATION", "MODEL_DEFINITION", "CHECKPOINT", "CONFIGURATION", "DEPENDENCY", "PREPROCESSING", "METRIC", "EXECUTION_SCRIPT")


def repository_file(path: Column) -> Column:
    """(file_type, role) of a file by its path alone."""
    name = F.lower(F.substring_index(path, "/", -1))
    kind = kinds.first_rule(name, FILE_TYPES, "OTHER")
    folder = F.when(path.contains("/"), F.lower(F.regexp_replace(path, r"/[^/]*$", ""))).otherwise(".")
    words = F.concat(folder, F.lit(" "), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    fixed = F.create_map(*[F.lit(x) for kv in ROLES_OF_TYPES.items() for x in kv])
    by_path = F.coalesce(kinds.first_rule(words, PATH_ROLES), F.when(kind == "SHELL", "EXECUTION_SCRIPT").when(kind == "OTHER", "UNKNOWN").otherwise("UTILITY"))
    return F.struct(kind.alias("file_type"), F.coalesce(F.try_element_at(fixed, kind), by_path).alias("role"))


def experiment_terms(*values: Column) -> Column:
    """Distinct words of three letters and digits or more that say something of an experiment."""
    words = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)) for v in values]))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*NO_TERMS)))


def path_lines(readme: Column, path: Column) -> Column:
    """The lines of a text in which a path stands, for its first two occurrences: 400 code points of each."""
    low, name = F.lower(readme), F.lower(path)
    first = F.instr(low, name)
    second = F.when(first > 0, F.position(name, low, first + F.length(name))).otherwise(0)

    def line(at: Column) -> Column:
        whole = F.concat(F.substring_index(F.substring(readme, F.lit(1), at - 1), "\n", -1), F.substring_index(F.substring(readme, at, F.length(readme)), "\n", 1))
        return F.when(at > 0, F.concat(F.lit("README: "), F.substring(F.trim(F.regexp_replace(whole, r"(?U)\s+", " ")), 1, 400)))

    return F.when((F.coalesce(readme, F.lit("")) != "") & (name != ""), F.array_compact(F.array(line(first), line(second)))).otherwise(F.array().cast("array<string>"))


def rare_dataset_terms(experiments: DataFrame) -> DataFrame:
    """(case_id, experiment_id, rare): the terms of an experiment's data set that no other data set of its case has."""
    named = experiments.filter("coalesce(dataset, '') <> ''").select("case_id", F.lower("dataset").alias("d"), "experiment_id", F.explode(experiment_terms(F.col("dataset"))).alias("t"))
    rare = named.groupBy("case_id", "t").agg(F.count_distinct("d").alias("n")).filter("n = 1")
    return named.join(rare, ["case_id", "t"]).groupBy("case_id", "experiment_id").agg(F.array_sort(F.collect_set("t")).alias("rare"))


def inspect(artifacts: DataFrame, experiments: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The observed files of code artifacts by experiment, and a row per mapped pair of artifact and experiment.

    ``artifacts`` is what ``discover`` returns, ``repositories`` has besides file_tree (path, is_directory) and
    readme_available. Files: case_id, artifact_id, experiment_id, path, file_type, role, relevance_status, confidence,
    evidence, matched. Maps: missing_roles, unknown_roles, readiness and counts. A pair is mapped if the artifact
    was found for the experiment, a file is relevant to it, or the repository's relation is doubtful or it cannot be
    read. Paths that differ in case alone are one, the first; a repository that is not known has no files.
    """
    code = artifacts.filter("type = 'CODE' and repository is not null").select("case_id", "artifact_id", F.col("experiment_id").alias("found_for"), "repository", "relationship_status")
    shown = F.transform(F.coalesce("visible_files", F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), F.lit(False).alias("is_directory")))
    tree = F.coalesce("file_tree", F.array().cast("array<struct<path: string, is_directory: boolean>>"))
    known = repositories.select(F.col("canonical_url").alias("repository"), "accessible", F.coalesce("readme", F.lit("")).alias("readme"), F.when(F.size(tree) > 0, tree).otherwise(shown).alias("tree"))
    paths = known.select("repository", "readme", F.posexplode("tree").alias("k", "x")).filter("not coalesce(x.is_directory, false)").withColumn("path", F.regexp_replace("x.path", "^/+|/+$", "")).filter("path <> ''")
    paths = paths.groupBy("repository", F.lower("path").alias("low")).agg(F.min_by(F.struct("path", "readme"), "k").alias("x")).select("repository", "x.*")
    paths = paths.withColumn("kind", repository_file(F.col("path"))).filter("not (kind.file_type = 'OTHER' and kind.role = 'UNKNOWN')")
    paths = paths.select("repository", "path", "kind.*", path_lines(F.col("readme"), F.col("path")).alias("lines"), F.regexp_replace(F.lower("path"), "[^a-z0-9]+", " ").alias("plain"))
    e = experiments.join(rare_dataset_terms(experiments), ["case_id", "experiment_id"], "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    model = F.array_except(experiment_terms(F.col("model")), F.array(*[F.lit(q) for q in QUALIFIERS]))
    objective = F.lower(F.coalesce("objective", F.lit("")))
    special = F.when(objective.contains("architecture search") | objective.rlike(r"\bnas\b"), F.array(F.lit("nas"), F.lit("architecture search"))).when(objective.contains("continual learning") | objective.contains("incremental learning"), F.array(F.lit("continual"), F.lit("incremental"))).otherwise(F.array().cast("array<string>"))
    specific = F.array_union(F.array_intersect(experiment_terms(F.col("dataset")), F.col("rare")), F.array_except(experiment_terms(F.col("split"), F.col("metric"), F.col("baseline")), model))
    e = e.select("case_id", "experiment_id", "rare", "model", "dataset", model.alias("model_terms"), specific.alias("specific"), special.alias("special"))
    pairs = code.join(known.select("repository", "accessible"), "repository", "left").join(e, "case_id")
    uncertain = ~F.coalesce("accessible", F.lit(False)) | F.col("relationship_status").isin("AMBIGUOUS", "PARTIAL")
    pairs = pairs.withColumns({"uncertain": uncertain, "direct": F.coalesce(F.col("found_for") == F.col("experiment_id"), F.lit(False))})

    said = F.lower(F.array_join("lines", " "))
    tokens = F.split("plain", " ")
    in_path, in_model = F.array_intersect("specific", tokens), F.array_intersect("model_terms", tokens)
    in_readme = F.filter("specific", lambda t: F.contains(said, t))
    least = F.greatest(F.lit(1), F.least(F.lit(2), F.size("rare")))
    fitting = (F.size(in_path) > 0) | (F.size(in_model) > 0) | (F.size(in_readme) >= least)
    special_fits = (F.size("special") == 0) | F.exists("special", lambda t: F.contains(F.col("plain"), t) | F.contains(said, t))
    doubtful = F.col("relationship_status").isin("AMBIGUOUS", "PARTIAL") | ~special_fits
    possible = ((F.size("lines") > 0) & ~F.col("role").isin("DOCUMENTATION", "UNKNOWN", "UTILITY")) | F.col("role").isin(*WORKING_ROLES)
    status = F.when(fitting & ~doubtful, "RELEVANT").when(fitting | possible, "POSSIBLY_RELEVANT").otherwise("UNKNOWN")
    sure = F.when(fitting & ~doubtful, "HIGH").when(fitting | ((F.size("lines") > 0) & ~F.col("role").isin("DOCUMENTATION", "UNKNOWN", "UTILITY")), "MEDIUM").otherwise("LOW")
    matched = F.array_sort(F.array_distinct(F.concat(in_path, in_model, in_readme)))
    noted = F.when(fitting, F.concat(F.lit("Repository evidence matches experiment term(s): "), F.array_join(matched, ", "), F.lit(".")))
    evidence = F.array_compact(F.concat(F.array(F.concat(F.lit("Observed repository path: "), "path")), "lines", F.array(noted)))
    told = F.lower(F.array_join("evidence", " "))
    role = F.when((F.col("role") == "ENTRYPOINT") & (told.contains("--do_eval") | told.contains("evaluation")), "EVALUATION").otherwise(F.col("role"))
    files = pairs.join(paths, "repository").withColumns({"relevance_status": status, "confidence": sure, "evidence": evidence, "matched": F.when(fitting, matched).otherwise(F.array().cast("array<string>"))}).withColumn("role", role)

    key = ["case_id", "artifact_id", "experiment_id"]
    roles = lambda s: F.array_sort(F.collect_set(F.when(F.col("relevance_status") == s, F.col("role"))))
    counts = files.groupBy(*key).agg(roles("RELEVANT").alias("available"), roles("POSSIBLY_RELEVANT").alias("possible"), F.count(F.when(F.col("relevance_status") == "RELEVANT", 1)).alias("n_relevant"), F.count(F.when(F.col("relevance_status") == "POSSIBLY_RELEVANT", 1)).alias("n_possible"), F.count("*").alias("n_files"))
    maps = pairs.select(*key, "accessible", "uncertain", "direct", "model", "dataset").join(counts, key, "left").na.fill(0, ["n_relevant", "n_possible", "n_files"])
    empty = F.array().cast("array<string>")
    maps = maps.withColumns({"available": F.coalesce("available", empty), "possible": F.coalesce("possible", empty)}).filter(F.col("direct") | (F.size("available") > 0) | F.col("uncertain"))
    wanted = kinds.expected_roles(F.col("model"), F.col("dataset"))
    missing = F.array_except(F.array_except(wanted, "available"), "possible")
    unknown = F.array_except(F.array_intersect(wanted, "possible"), "available")
    maps = maps.withColumns({"missing_roles": missing, "unknown_roles": unknown})
    ready = kinds.file_readiness(F.col("n_relevant"), F.col("n_possible"), F.size("missing_roles"), F.coalesce("accessible", F.lit(False)))
    maps = maps.select(*key, "missing_roles", "unknown_roles", ready.alias("readiness"), "n_files", "n_relevant", "n_possible")
    files = files.join(maps.select(*key), key, "left_semi").select(*key, "path", "file_type", "role", "relevance_status", "confidence", "evidence", "matched")
    return files, maps
