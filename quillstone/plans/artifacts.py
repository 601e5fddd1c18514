"""Queries of artifacts: each part is a paper whose text links a repository and a data set, and names others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import discovery
from quillstone.plans.registry import query
from quillstone.plans.tables import table


def _case(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, their experiments, and the repositories of large parts."""
    part, n = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    even, none = F.col("p_partkey") % 2 == 0, F.lit(None).cast("string")
    text = F.concat(
        F.lit("1 Methods\n"), F.when(even, "Our code").otherwise("Some code"), F.lit(" is at https://github.com/parts/\n  part-"), n, F.lit(", see there. "), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(""),
        F.lit("The dataset is at www.parts.org/sets/set_"), n, F.lit(". "), F.when(F.col("p_partkey") % 5 == 0, "Supplementary material comes later.").otherwise(""),
    )
    papers = part.select(n.alias("case_id"), text.alias("text"), F.lit("").alias("title"), F.array().cast("array<string>").alias("authors"))
    experiments = part.select(n.alias("case_id"), F.lit("E").alias("experiment_id"), F.lit(0).alias("place"), F.lit("measure").alias("objective"), F.col("p_name").alias("dataset"), none.alias("split"), F.concat(F.lit("Net"), "p_size").alias("model"), F.lit("accuracy").alias("metric"), none.alias("baseline"), F.array().cast("array<string>").alias("evidence_locations"))
    url = F.concat(F.lit("https://github.com/parts/part-"), n)
    word = F.substring_index("p_name", " ", 1)
    tree = F.array(F.struct(F.concat(F.lit("runs/"), word, F.lit("/train.py")).alias("path"), F.lit(False).alias("is_directory")), F.struct(F.lit("requirements.txt").alias("path"), F.lit(False).alias("is_directory")), F.struct(F.lit("notes.md").alias("path"), F.lit(False).alias("is_directory")))
    repositories = part.filter("p_size > 25").select(url.alias("canonical_url"), F.lit("github").alias("platform"), F.concat(F.lit("part-"), n).alias("name"), F.lit(True).alias("accessible"), none.alias("description"), none.alias("readme"), F.array(F.lit("notes.md"), F.lit("requirements.txt"), F.lit("train.py")).alias("visible_files"), tree.alias("file_tree"), F.lit("main").alias("default_branch"), none.alias("license_name"))
    return papers, experiments, repositories


@query("tvf17_artifacts", """
WITH p AS (SELECT *, p_partkey::VARCHAR AS n, p_size > 25 AS known, p_partkey % 2 = 0 AS official, p_partkey % 3 = 0 AS named FROM part),
a AS (
  SELECT n, 0 AS stage, 0 AS k, 'CODE' AS type, 'part-' || n AS name, CASE WHEN NOT known THEN 'PARTIAL' WHEN official THEN 'VERIFIED' ELSE 'FOUND' END AS relationship_status, CASE WHEN known THEN 'FOUND' ELSE 'INACCESSIBLE' END AS availability_status, CASE WHEN named THEN 'E' END AS experiment_id FROM p
  UNION ALL SELECT n, 0, 1, 'DATASET', 'set ' || n, 'FOUND', 'FOUND', CASE WHEN named THEN 'E' END FROM p
  UNION ALL SELECT n, 1, 0, 'DEPENDENCY', 'requirements.txt', CASE WHEN official THEN 'VERIFIED' ELSE 'PARTIAL' END, 'FOUND', CASE WHEN named THEN 'E' END FROM p WHERE known
  UNION ALL SELECT n, 1, 1, 'EXECUTION_SCRIPT', 'train.py', CASE WHEN official THEN 'VERIFIED' ELSE 'PARTIAL' END, 'FOUND', CASE WHEN named THEN 'E' END FROM p WHERE known
  UNION ALL SELECT n, 2, 0, 'DATASET', p_name, 'PARTIAL', 'MISSING', 'E' FROM p WHERE NOT named
  UNION ALL SELECT n, 2, 1, 'MODEL', 'Net' || p_size, 'PARTIAL', 'MISSING', 'E' FROM p
  UNION ALL SELECT n, 3, 0, 'SUPPLEMENTARY', NULL, 'PARTIAL', 'MISSING', NULL FROM p WHERE p_partkey % 5 = 0)
SELECT n AS case_id, 'ART-' || lpad((row_number() OVER (PARTITION BY n ORDER BY stage, k))::VARCHAR, 3, '0') AS artifact_id, type, name, relationship_status, availability_status, experiment_id FROM a""")
def tvf17(spark, sf):
    """Artifacts of every paper with their relation to it."""
    return discovery.discover(*_case(spark, sf)).select("case_id", "artifact_id", "type", "name", "relationship_status", "availability_status", "experiment_id")


def _inspected(spark, sf) -> tuple[DataFrame, DataFrame]:
    papers, experiments, repositories = _case(spark, sf)
    return discovery.inspect(discovery.discover(papers, experiments, repositories), experiments, repositories)


@query("tvf18_files", """
SELECT p_partkey::VARCHAR AS case_id, 'runs/' || split_part(p_name, ' ', 1) || '/train.py' AS path, 'TRAINING' AS role, 'RELEVANT' AS relevance_status, split_part(p_name, ' ', 1) AS matched FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey::VARCHAR, 'requirements.txt', 'DEPENDENCY', 'POSSIBLY_RELEVANT', '' FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey::VARCHAR, 'notes.md', 'DOCUMENTATION', 'UNKNOWN', '' FROM part WHERE p_size > 25""")
def tvf18_files(spark, sf):
    """Files of the repositories by experiment, with the terms that speak for each."""
    return _inspected(spark, sf)[0].select("case_id", "path", "role", "relevance_status", F.array_join("matched", ",").alias("matched"))


@query("tvf18_maps", """
SELECT p_partkey::VARCHAR AS case_id, CASE WHEN p_size > 25 THEN 'PARTIAL' ELSE 'MISSING' END AS readiness, CASE WHEN p_size > 25 THEN 3 ELSE 0 END AS n_files, CASE WHEN p_size > 25 THEN 5 ELSE 6 END AS n_missing FROM part""")
def tvf18_maps(spark, sf):
    """How ready each paper's repository is for its experiment."""
    return _inspected(spark, sf)[1].select("case_id", "readiness", "n_files", F.size("missing_roles").alias("n_missing"))
