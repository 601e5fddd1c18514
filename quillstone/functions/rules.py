"""Rules of readiness, review, routes and relations as expressions (SC23, SC64-SC65, SC72, SC77-SC88, F16-F21, JN12, JN18, PRJ10-PRJ15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.artifacts import PAPER_HOSTS, first_rule, host, option_text
from quillstone.functions.identifiers import doi_extract

#: What a file of a repository is, by its name, in order.
FILE_TYPES = (
    ("DEPENDENCY", r"^(requirements\.txt|pyproject\.toml|setup\.py|environment\.ya?ml|package\.json|package-lock\.json|poetry\.lock)$"),
    ("CONTAINER", r"^(dockerfile|docker-compose\.ya?ml)$"),
    ("CONFIG", r"\.(yaml|yml|toml|ini|cfg)$|config"),
    ("EXECUTION_SCRIPT", r"\.(sh|bash)$|^(train|evaluate|eval|run)\.py$"),
    ("CHECKPOINT", r"\.(ckpt|pth|pt|safetensors)$"),
)
#: Outcomes of a claim and confidences that a person has to look at.
REVIEWED_STATUSES = ("NOT_SUPPORTED", "CONTRADICTED", "UNCLEAR", "SOURCE_UNAVAILABLE")
REVIEWED_CONFIDENCES = ("LOW", "UNKNOWN")
#: Wording around a repository's link.
OFFICIAL = r"(?i)\b(official|our)\s+(?:code|implementation|repository)\b"
DOUBTFUL = r"(?i)\b(unofficial|possible|mirror|related repository)\b"
#: Wording of a split that holds for all results, and of results that it is for.
STANDARD_SPLIT = r"(?i)\b(?:use|using|used)\s+(?:the\s+)?standard\s+train\s*/\s*test\s+splits?\b"
OF_TEST = r"(?i)\b(?:test|testing)\b"
#: Words before a bracketed number that make it no citation, and what such a number stands before.
NO_CITATION = r"(?i)\b(eq|equation|formula|step|clause|case|figure|fig|table)\b"
ENUMERATED = r"\(\s*\d+\s*\)\s+[A-Z][a-z]+"
UNAVAILABLE = ("MISSING", "INACCESSIBLE")


def _has(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def file_type(path: Column) -> Column:
    return first_rule(F.lower(F.substring_index(path, "/", -1)), FILE_TYPES)


def of_paper_host(url: Column) -> Column:
    """Whether a link goes to a paper and so to no artifact."""
    return host(url).isin(*PAPER_HOSTS)


def document_identifier(links: Column, text: Column) -> Column:
    """The identifier of a document: of its first link that has one, else of its first 5,000 characters."""
    linked = F.filter(F.transform(F.coalesce(links, F.array().cast("array<string>")), doi_extract), lambda d: d.isNotNull())
    return F.coalesce(F.try_element_at(linked, F.lit(1)), doi_extract(F.substring(F.coalesce(text, F.lit("")), 1, 5000)))


def first_of_registries(*records: Column) -> Column:
    """The first registry's record that is there: the metadata of a reference that gives its identifier."""
    return F.coalesce(*records)


def missing_identifier_route(candidate: Column, doi: Column, used: Column, title: Column) -> Column:
    """How a reference without identifier goes on: ``candidate`` tells whether a work was found, ``used`` whether its
    identifier is another reference's already."""
    return (
        F.when(~F.coalesce(candidate, F.lit(False)), "DOI_MISSING")
        .when(~_has(doi), "WORK_FOUND_NO_DOI")
        .when(F.coalesce(used, F.lit(False)) | (F.coalesce(title, F.lit(0.0)) < 0.80), "DOI_MISSING")
        .otherwise("RECOVERED")
    )


def requirement_status(artifact: Column) -> Column:
    """What an artifact's status means for what needs it; null is no artifact."""
    return F.when(artifact.isNull() | (artifact == "MISSING"), "MISSING").when(artifact == "INACCESSIBLE", "INACCESSIBLE").when(artifact == "AMBIGUOUS", "UNKNOWN").otherwise("AVAILABLE")


def eligible_target(objective: Column, dataset: Column, split: Column, atomic: Column, value: Column) -> Column:
    return _has(objective) & _has(dataset) & _has(split) & F.coalesce(atomic, F.lit(False)) & value.isNotNull()


def target_readiness(eligible: Column, code: Column, needs: Column, missing: Column, conflicts: Column, plan: Column) -> Column:
    """Readiness of a target: ``needs`` has the statuses of its data, models and checkpoints."""
    gone = F.array(*[F.lit(s) for s in UNAVAILABLE])
    blocked = requirement_status(code).isin(*UNAVAILABLE) | F.arrays_overlap(needs, gone)
    return F.when(~eligible, "UNKNOWN").when(blocked, "BLOCKED").when(missing | conflicts, "PARTIALLY_READY").otherwise(plan)


def review_required(status: Column, confidence: Column) -> Column:
    return status.isin(*REVIEWED_STATUSES) | confidence.isin(*REVIEWED_CONFIDENCES)


def corrected_support(status: Column, text_missing: Column) -> Column:
    """A support status once sources were looked at: what some of them cannot tell is unclear."""
    return F.when((status == "SOURCE_UNAVAILABLE") | ((status == "NOT_SUPPORTED") & text_missing), "UNCLEAR").otherwise(status)


def investigation_status(compared: Column) -> Column:
    return F.when(compared == "VERIFIED", "NO_DISCREPANCY").when(compared == "BLOCKED", "BLOCKED").when(compared == "NOT_REPRODUCED", "DETECTED").otherwise("INCONCLUSIVE")


def report_status(rolled: Column, environment_blocked: Column, issues: Column, unsettled: Column, qualified: Column) -> Column:
    """A report's status. ``rolled`` is that of its targets; ``unsettled`` says that claims, evidence or an
    investigation are open, ``qualified`` that some part is less than fully supported."""
    return (
        F.when(environment_blocked | (rolled == "BLOCKED"), "BLOCKED").when(issues, "INCONCLUSIVE")
        .when((rolled == "VERIFIED") & unsettled, "INCONCLUSIVE").when((rolled == "VERIFIED") & qualified, "PARTIALLY_REPRODUCED").otherwise(rolled)
    )


def repository_relation(accessible: Column, context: Column, title_score: Column, author_named: Column) -> Column:
    """(relation, confidence) of a linked repository to its paper. A title score of 90 or more is a match; an author
    named besides changes neither part, as a matching title is enough."""
    both = lambda r, c: F.struct(F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    around = F.coalesce(context, F.lit(""))
    return (
        F.when(~accessible, both("PARTIAL", "LOW")).when(around.rlike(DOUBTFUL), both("AMBIGUOUS", "LOW"))
        .when((title_score >= 90) | around.rlike(OFFICIAL), both("VERIFIED", "HIGH")).otherwise(both("FOUND", "MEDIUM"))
    )


def _same_name(a: Column, b: Column) -> Column:
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]+", "") for c in (a, b))
    return x.contains(y) | y.contains(x)


def command_fits(command: Column, objective: Column, dataset: Column, model: Column) -> Column:
    """Whether a documented command can be an experiment's: its options name no other data, model or image count."""
    told = F.struct(*[F.coalesce(option_text(command, n), F.lit("")).alias(n) for n in ("dataset", "model", "ipc")])
    search = F.lower(objective).contains("architecture search") | objective.rlike(r"(?i)\bnas\b")
    ok = lambda c: F.coalesce(c, F.lit(True))

    def fits(o: Column) -> Column:
        data, net, ipc = (o[n] for n in ("dataset", "model", "ipc"))
        wanted = F.nullif(F.regexp_extract(objective, r"(?i)\b(\d+)\s+images?\s*(?:/|per)\s*class\b", 1), F.lit(""))
        return (
            ((data == "") | ok(~_has(dataset) | _same_name(data, dataset))) & ((net == "") | (_has(model) & ok(_same_name(net, model))))
            & ((ipc == "") | ok(ipc == wanted)) & (~search | command.rlike(r"(?i)\b(?:nas|architecture)\b"))
        )

    # Options are found once, however often they are asked for.
    return F.get(F.transform(F.array(told), fits), F.lit(0))


def fits_files(command: Column, paths: Column) -> Column:
    """Whether one of the scripts that a command names is mapped, by path, or by name where no folder is given."""
    named = F.regexp_extract_all(command, F.lit(r"([A-Za-z0-9_./-]+\.(?:py|sh|bash|ipynb|js|ts|jar|exe))"), F.lit(1))
    is_of = lambda s, p: (p == s) | (~s.contains("/") & (F.substring_index(p, "/", -1) == s))
    mapped = lambda s: F.exists(paths, lambda p: is_of(F.lower(s), F.lower(p)))
    return F.get(F.transform(F.array(named), lambda scripts: (F.size(scripts) == 0) | F.exists(scripts, mapped)), F.lit(0))


def split_of_protocol(split: Column, whole_text: Column, objective: Column, metric: Column) -> Column:
    """The split of a result: its own, else ``test`` where the text states the standard split and the result is of a test."""
    of_test = F.concat_ws(" ", objective, F.coalesce(metric, F.lit(""))).rlike(OF_TEST)
    return F.when(split.isNull() & whole_text.rlike(STANDARD_SPLIT) & of_test, "test").otherwise(split)


def citing_numbers(context: Column, keys: Column) -> Column:
    """The numbers of a marker in round brackets that cite something: no equations, steps, enumerations or years."""
    none = F.array().cast("array<long>")
    return F.when(context.rlike(NO_CITATION) | context.rlike(ENUMERATED), none).otherwise(F.filter(keys, lambda k: k < 1900))


def located(locations: Column, chunk: Column) -> Column:
    """The locations of a record, the chunk's own where it has none."""
    return F.when(F.size(F.coalesce(locations, F.array().cast("array<string>"))) == 0, F.array(chunk)).otherwise(locations)


def picked_text(payload: Column, *names: str) -> Column:
    """The first of some fields of a JSON object that is a text and not blank; a bare text is itself."""
    bare = F.when(~payload.rlike(r"^\s*[\[{]"), F.trim(payload))
    found = [F.trim(F.get_json_object(payload, f"$['{n}']")) for n in names or ("$", "value", "#text", "_")]
    return F.coalesce(F.nullif(bare, F.lit("")), *[F.nullif(c, F.lit("")) for c in found])


def author_year_cited(marker: Column, author: Column) -> Column:
    """``surname_year`` of an author-year marker; null where either is not there."""
    name, year = F.regexp_replace(F.lower(F.substring_index(F.trim(author), " ", 1)), "[^a-z]", ""), F.regexp_extract(marker, r"(?:19|20)\d{2}", 0)
    return F.when((name != "") & (year != ""), F.concat_ws("_", name, year))


def author_year_listed(authors: Column, year: Column) -> Column:
    """``surname_year`` of a bibliography entry: the last word of its first author."""
    first = F.trim(F.substring_index(F.substring_index(F.coalesce(authors, F.lit("")), ";", 1), ",", 1))
    name = F.regexp_replace(F.lower(F.substring_index(first, " ", -1)), "[^a-z]", "")
    return F.when((name != "") & year.isNotNull(), F.concat_ws("_", name, year.cast("string")))


def author_year_consistency(cited: Column, listed: Column, entries: Column) -> Column:
    """(orphans, missing, score) of two sets of author-year keys; ``entries`` is the length of the bibliography."""
    orphans, missing = F.array_except(listed, cited), F.array_except(cited, listed)
    penalty = (1.5 * F.size(orphans) + 3 * F.size(missing)) / F.greatest(F.lit(1), entries) * 100
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - penalty)), 1)
    return F.struct(F.array_sort(orphans).alias("orphans"), F.array_sort(missing).alias("missing"), score.alias("score"))


def citation_keys(number: Column, ordinal: Column, authors: Column, years: Column) -> Column:
    """Keys of an entry: its number, ``[n]`` or else its place, and every author with every year."""
    own = F.coalesce(F.nullif(F.regexp_extract(number, r"^\s*\[(\d+)\]", 1), F.lit("")), ordinal.cast("string"))
    pairs = F.flatten(F.transform(authors, lambda a: F.transform(years, lambda y: F.concat_ws("_", F.lower(a), y.cast("string")))))
    return F.concat(F.array(own), pairs)


def python_bool(flag: Column) -> Column:
    """A boolean as the text that exports have for it."""
    return F.when(flag, "True").when(~flag, "False").otherwise("")


#: Ways to verify a paper, by its domain.
METHODS = {
    "AI_ML": ("COMPUTATIONAL_REPRODUCTION",),
    "SOCIAL_SCIENCE": ("STATISTICAL_VERIFICATION", "DOCUMENTARY_VERIFICATION", "QUALITATIVE_EVIDENCE_REVIEW", "HUMAN_EXPERT_VALIDATION"),
    "HUMANITIES": ("DOCUMENTARY_VERIFICATION", "QUALITATIVE_EVIDENCE_REVIEW", "HUMAN_EXPERT_VALIDATION"),
    "ENGINEERING": ("COMPUTATIONAL_REPRODUCTION", "EXPERIMENTAL_VERIFICATION", "DOCUMENTARY_VERIFICATION"),
    "BIOLOGY": ("COMPUTATIONAL_REPRODUCTION", "EXPERIMENTAL_VERIFICATION", "DOCUMENTARY_VERIFICATION"),
    "PHYSICS_CHEMISTRY": ("COMPUTATIONAL_REPRODUCTION", "EXPERIMENTAL_VERIFICATION", "DOCUMENTARY_VERIFICATION"),
    "OTHER": ("DOCUMENTARY_VERIFICATION", "HUMAN_EXPERT_VALIDATION"),
}


def verification_methods(domain: Column) -> Column:
    """The ways to verify a paper of a domain, in order; of another or no domain UNKNOWN."""
    known = F.create_map(*[x for d, names in METHODS.items() for x in (F.lit(d), F.array(*map(F.lit, names)))])
    return F.coalesce(F.try_element_at(known, F.coalesce(domain, F.lit(""))), F.array(F.lit("UNKNOWN")))


def verification_status(domain: Column, plans: Column, has_dataset: Column) -> Column:
    """What can be verified, by the domain, the statuses of a paper's plans and whether its data set is there."""
    of_plans = (
        F.when(F.array_contains(plans, "READY_FOR_EXECUTION"), "COMPUTATIONALLY_REPRODUCIBLE")
        .when(F.array_contains(plans, "PARTIALLY_READY"), "PARTIALLY_VERIFIABLE")
        .when((F.size(plans) > 0) & F.forall(plans, lambda p: p == "BLOCKED"), "INACCESSIBLE")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    return (
        F.when(domain == "AI_ML", of_plans)
        .when(domain == "SOCIAL_SCIENCE", F.when(has_dataset, "PARTIALLY_VERIFIABLE").otherwise("REQUIRES_HUMAN_VALIDATION"))
        .when(domain == "HUMANITIES", "DOCUMENTARILY_VERIFIABLE")
        .when(domain.isin("ENGINEERING", "BIOLOGY", "PHYSICS_CHEMISTRY"), "PARTIALLY_VERIFIABLE")
        .otherwise("UNKNOWN")
    )
