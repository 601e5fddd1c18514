"""Join-shaped matching: contexts, recovery candidates, relevance, scopes (JN03-JN26)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.fuzzy import token_set_ratio


def first_context(references: DataFrame, markers: DataFrame, doc: str, number: str = "reference_no", keys: str = "keys", context: str = "context", position: str = "position") -> DataFrame:
    """Each reference with the context of the first marker that cites its number, grouped and ranged ones too."""
    first = markers.select(doc, F.explode(keys).alias(number), position, context).groupBy(doc, number).agg(F.min_by(context, position).alias(context))
    return references.join(first, [doc, number], "left")


def linked_markers(markers: DataFrame, numbers: DataFrame, doc: str, keys: str = "keys") -> DataFrame:
    """Markers with the keys that no bibliography entry of their document has."""
    known = numbers.groupBy(doc).agg(F.collect_set("number").alias("__known"))
    return markers.join(known, doc, "left").withColumn("missing_keys", F.array_except(keys, F.coalesce("__known", F.array().cast("array<long>")))).drop("__known")


#: What a provider's candidates are worth more.
BONUS = {"scopus": 0.05, "crossref": 0.04, "openalex": 0.0}


def recover(candidates: DataFrame, reference: str, score: str = "composite", title: str = "title_similarity", doi: str = "doi", provider: str = "provider", ordinal: str = "ordinal") -> DataFrame:
    """The best candidate of each reference: with an identifier by score and provider's bonus, the first of
    equals; else without one, if its title and score are high enough."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), F.col(provider)), F.lit(0.0))
    has = F.coalesce(F.col(doi), F.lit("")) != ""
    usable = candidates.filter(has | ((F.col(title) >= 0.90) & (F.col(score) >= 0.65)))
    best = F.max_by(F.struct(*[c for c in candidates.columns if c != reference]), F.struct(has, F.col(score) + bonus, -F.col(ordinal)))
    return usable.groupBy(reference).agg(best.alias("b")).select(reference, "b.*")


def repaired_position(pairs: DataFrame, key: list[str], positional: str, similarity: str, ordinal: str) -> DataFrame:
    """The ground-truth row of each reference: that of its position unless another is clearly the one.

    ``pairs`` has every candidate of a reference within its document. A positional similarity under 0.35 gives
    way to the best other one of at least 0.70; without a positional row the first of at least 0.70 is taken.
    """
    here = F.max(F.when(F.col(positional), F.col(similarity)))
    best = F.max_by(F.struct(ordinal, similarity), F.struct(F.col(similarity), -F.col(ordinal)))
    first = F.min(F.when(F.col(similarity) >= 0.70, F.col(ordinal)))
    own = F.max(F.when(F.col(positional), F.col(ordinal)))
    g = pairs.groupBy(*key).agg(here.alias("h"), best.alias("b"), first.alias("f"), own.alias("o"), F.count("*").alias("n"))
    chosen = F.when(F.col("o").isNull(), F.col("f")).when((F.col("h") < 0.35) & (F.col("n") > 1) & (F.col("b")[similarity] >= 0.70), F.col("b")[ordinal]).otherwise(F.col("o"))
    return g.select(*key, chosen.alias(ordinal))


def scoped(specs: DataFrame, wanted: DataFrame, owner: str, spec_id: str, is_global: str) -> DataFrame:
    """For each wanted owner its own specification, else a global one, the least id first."""
    own = wanted.join(specs.filter(~F.col(is_global)), owner, "left").groupBy(owner).agg(F.min(spec_id).alias("own"))
    common = specs.filter(is_global).agg(F.min(spec_id).alias("common"))
    return own.join(F.broadcast(common)).select(owner, F.coalesce("own", "common").alias(spec_id))


def relevance(files: DataFrame, experiments: DataFrame, file: str, experiment: str, file_terms: str, wanted_terms: str) -> DataFrame:
    """Terms that files and experiments share, by pair; pairs come from the terms, not from all with all."""
    a = files.select(file, F.explode(file_terms).alias("__t"))
    b = experiments.select(experiment, F.explode(wanted_terms).alias("__t"))
    return a.join(b, "__t").groupBy(experiment, file).agg(F.count("*").alias("shared"))


def rolled_up(df: DataFrame, key: str, parts: Mapping[str, Column]) -> DataFrame:
    """One row for each key with sorted lists of what belongs to it; nulls belong to nothing."""
    return df.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in parts.items()])


def newest_containing(cases: DataFrame, targets: str, wanted: DataFrame, target: str, time: str, case: str) -> DataFrame:
    """For each wanted target the newest case whose list has it."""
    each = cases.select(F.explode(targets).alias(target), time, case)
    return wanted.join(each, target).groupBy(target).agg(F.max_by(case, F.struct(time, case)).alias(case))


def first_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def associated(contexts: DataFrame, experiments: DataFrame, paper: str, context: str, experiment: str, order: str, terms: list[str], least: float = 80.0) -> DataFrame:
    """``contexts`` with the experiment of the same ``paper`` whose terms fit best, null below ``least``.

    Of ``terms`` (data set, model) those of three characters or more count, the better one for each experiment;
    of equal experiments the first by ``order`` wins. Only rows of one paper meet. Rows with equal texts are
    scored once.
    """
    wanted = experiments.select(paper, experiment, order, F.explode(F.array_distinct(F.array(*terms))).alias("__term")).filter(F.length("__term") >= 3)
    pairs = contexts.select(paper, context).distinct().join(wanted, paper)
    scored = pairs.withColumn("__score", token_set_ratio(F.col("__term"), F.col(context))).filter(F.col("__score") >= least)
    best = scored.groupBy(paper, context).agg(F.min_by(experiment, F.struct(-F.col("__score"), F.col(order))).alias(experiment))
    return contexts.join(best, [paper, context], "left")
