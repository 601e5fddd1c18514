import pytest
from pyspark.sql import functions as F

from quillstone.operators import discovery as d

EXPERIMENT = "case_id string, experiment_id string, place int, objective string, dataset string, split string, model string, metric string, baseline string, evidence_locations array<string>"
REPOSITORY = "canonical_url string, platform string, name string, accessible boolean, description string, readme string, readme_available boolean, visible_files array<string>, file_tree array<struct<path: string, is_directory: boolean>>, default_branch string, license_name string"
GIT = "https://github.com/group/berts"
README = "Use run_classifier.py for GLUE fine-tuning and evaluation.\nUse run_squad.py for SQuAD fine-tuning.\nThe BERT model is in modeling.py and tokenization.py prepares input.\nInstall requirements.txt."


def papers(spark, text, title="A study of nets", authors=("Ann Lee",)):
    return spark.createDataFrame([("c", text, title, list(authors))], "case_id string, text string, title string, authors array<string>")


def experiments(spark, *rows):
    return spark.createDataFrame([("c", i, k, o, data, None, model, metric, None, ["page 3"]) for k, (i, o, data, model, metric) in enumerate(rows)], EXPERIMENT)


def repositories(spark, *rows):
    base = {"canonical_url": GIT, "platform": "github", "name": "berts", "accessible": True, "readme": README, "readme_available": True, "default_branch": "main"}
    return spark.createDataFrame([tuple((base | r).get(f.split()[0]) for f in REPOSITORY.split(", ") if not f.startswith("is_directory")) for r in rows], REPOSITORY)


def found(spark, text, repos=(), of=(("E1", "measure", "Corpus-X", "Net-X", "F1"),), **paper):
    out = d.discover(papers(spark, text, **paper), experiments(spark, *of), repositories(spark, *repos))
    return out.orderBy("artifact_id").collect()


def test_links_in_text(spark):
    text = "1 Introduction\nSee https://github.com/Group/\n  berts/tree/main, (www.x.org/data/set-one/). Ends http://a.b:80//c/?q=1#f; or gitlab.com/o/g/p.git and text/github.com/no/no. mail@x http://"
    rows = d.links(papers(spark, text)).orderBy("place").collect()
    assert [r.url for r in rows] == ["https://github.com/Group/berts/tree/main", "https://www.x.org/data/set-one", "http://a.b:80/c?q=1", "https://gitlab.com/o/g/p.git"]
    assert {r.location for r in rows} == {"1 Introduction"} and "See https://github.com/Group/ berts" in rows[0].context
    assert d.links(papers(spark, None)).count() == 0
    urls = spark.createDataFrame([("https://github.com/o/n/tree/main",), ("https://www.gitlab.com/o/g/p.git",), ("https://gitlab.example.org/o/p",), ("https://x.org/o/p",)], "u string").select(d.repository_url(F.col("u")).alias("r"))
    assert [r.r for r in urls.collect()] == ["https://github.com/o/n", "https://gitlab.com/o/g/p", None, None]


def test_candidates_of_four_streams(spark):
    text = f"Methods\nOur code is at {GIT} and again {GIT}/issues for all.\n" + "word " * 120 + "The Corpus-X dataset is at https://data.org/sets/corpus-x. Supplementary material follows."
    rows = found(spark, text, [{"visible_files": ["README.md", "requirements.txt", "train.py", "conf/a b.yaml"], "license_name": "MIT"}])
    assert [(r.artifact_id, r.type, r.name, r.discovery_method) for r in rows] == [
        ("ART-001", "CODE", "berts", "PAPER_URL"), ("ART-002", "DATASET", "corpus x", "PAPER_URL"), ("ART-003", "DEPENDENCY", "requirements.txt", "PUBLIC_REPOSITORY_LOOKUP"), ("ART-004", "EXECUTION_SCRIPT", "train.py", "PUBLIC_REPOSITORY_LOOKUP"),
        ("ART-005", "CONFIG", "conf/a b.yaml", "PUBLIC_REPOSITORY_LOOKUP"), ("ART-006", "MODEL", "Net-X", "MODEL_MENTION"), ("ART-007", "SUPPLEMENTARY", None, "PAPER_TEXT"),
    ]
    assert (rows[0].relationship_status, rows[0].confidence, rows[0].evidence_location) == ("VERIFIED", "HIGH", "Methods") and rows[0].notes[1] == "Visible license: MIT."
    assert rows[1].experiment_id == "E1" and rows[4].source_url == f"{GIT}/blob/main/conf/a%20b.yaml"
    assert (rows[5].availability_status, rows[5].evidence_location) == ("MISSING", "page 3")


@pytest.mark.parametrize(("words", "repo", "relation", "confidence"), [
    ("An unofficial copy:", {}, "AMBIGUOUS", "LOW"), ("See", {}, "FOUND", "MEDIUM"), ("See", {"description": "Code of A study of nets"}, "VERIFIED", "HIGH"), ("The official implementation:", {}, "VERIFIED", "HIGH"), ("See", {"accessible": False}, "PARTIAL", "LOW"),
])
def test_relations(spark, words, repo, relation, confidence):
    row = found(spark, f"{words} {GIT} there", [repo | {"visible_files": ["train.py"]}])
    assert (row[0].relationship_status, row[0].confidence, row[0].availability_status) == (relation, confidence, "INACCESSIBLE" if repo.get("accessible") is False else "FOUND")
    assert (row[1].type == "EXECUTION_SCRIPT") == (repo.get("accessible") is not False)


def test_nothing_known_and_nothing_said(spark):
    rows = found(spark, f"Source code is available: {GIT}. See https://arxiv.org/abs/1", of=())
    assert [(r.type, r.availability_status) for r in rows] == [("CODE", "INACCESSIBLE")]
    rows = found(spark, "The source code will be available soon.", of=())
    assert [(r.type, r.availability_status, r.discovery_method) for r in rows] == [("CODE", "MISSING", "PAPER_TEXT")]
    assert found(spark, None, of=()) == []


@pytest.mark.parametrize(("path", "kind", "role"), [
    ("train.py", "PYTHON", "TRAINING"), ("evaluation/run_eval.py", "PYTHON", "EVALUATION"), ("requirements.txt", "DEPENDENCY", "DEPENDENCY"), ("configs/bert.yaml", "CONFIG", "CONFIGURATION"), ("scripts/launch.sh", "SHELL", "EXECUTION_SCRIPT"),
    ("a/download_pretrained_checkpoints.sh", "SHELL", "DATA_PREPARATION"), ("models/model.ckpt", "CHECKPOINT", "CHECKPOINT"), ("Dockerfile", "CONTAINER", "CONFIGURATION"), ("README.md", "DOCUMENTATION", "DOCUMENTATION"), ("x/data.py", "PYTHON", "DATA_PREPARATION"),
    ("main.py", "PYTHON", "ENTRYPOINT"), ("metric.py", "PYTHON", "METRIC"), ("hnn.py", "PYTHON", "UTILITY"), ("x.dat", "OTHER", "UNKNOWN"), (".gitignore", "OTHER", "UNKNOWN"),
])
def test_kinds_of_files(spark, path, kind, role):
    assert tuple(spark.createDataFrame([(path,)], "p string").select(d.repository_file(F.col("p")).alias("k")).first().k) == (kind, role)


def code(spark, status="FOUND", of=None):
    return spark.createDataFrame([("c", "ART-001", of, "CODE", GIT, status)], "case_id string, artifact_id string, experiment_id string, type string, repository string, relationship_status string")


def mapped(spark, experiments_, paths, status="FOUND", of=None, **repo):
    tree = [(p, False) for p in paths]
    files, maps = d.inspect(code(spark, status, of), experiments(spark, *experiments_), repositories(spark, {"file_tree": tree} | repo))
    by = {}
    for r in files.collect():
        by.setdefault(r.experiment_id, {})[r.path] = r
    return by, {r.experiment_id: r for r in maps.collect()}


def test_files_go_to_the_experiments_they_name(spark):
    two = [("GLUE", "Fine-tune and evaluate BERT on GLUE", "GLUE", "BERT-Large", "accuracy"), ("SQUAD", "Fine-tune and evaluate BERT on SQuAD", "SQuAD", "BERT-Large", "F1")]
    files, maps = mapped(spark, two, ["run_classifier.py", "run_squad.py", "modeling.py", "tokenization.py", "requirements.txt", "README.md", "readme.md", "/x/", "blob.dat2"], of="SQUAD")
    assert set(files) == {"GLUE", "SQUAD"} and set(files["GLUE"]) == {"run_classifier.py", "run_squad.py", "modeling.py", "tokenization.py", "requirements.txt", "README.md"}
    assert files["GLUE"]["run_classifier.py"].relevance_status == files["SQUAD"]["run_squad.py"].relevance_status == "RELEVANT"
    assert files["GLUE"]["run_classifier.py"].role == "EVALUATION" and files["GLUE"]["run_classifier.py"].matched == ["glue"]
    assert files["GLUE"]["run_squad.py"].relevance_status != "RELEVANT" or "squad" not in files["GLUE"]["run_squad.py"].matched
    assert {m.readiness for m in maps.values()} == {"PARTIAL"}


def test_models_are_told_apart_by_paths(spark):
    two = [("R", "Evaluate RoBERTa on GLUE", "GLUE", "RoBERTa large", None), ("D", "Evaluate DeBERTa on GLUE", "GLUE", "DeBERTa XXL", None)]
    files, _ = mapped(spark, two, ["examples/NLU/roberta_large_mnli.sh", "examples/NLU/deberta_v2_xxlarge_mnli.sh"], readme="Scripts.")
    status = {e: [files[e][p].relevance_status for p in sorted(files[e])] for e in files}
    assert status == {"R": ["POSSIBLY_RELEVANT", "RELEVANT"], "D": ["RELEVANT", "POSSIBLY_RELEVANT"]}


def test_equal_names_are_told_apart_by_whole_paths(spark):
    two = [("SPRING", "Model an ideal mass-spring system", "Ideal mass-spring", "Hamiltonian net", "Energy MSE"), ("REAL", "Model a real pendulum", "Real pendulum", "Hamiltonian net", "Energy MSE")]
    readme = "Ideal mass-spring: `python3 experiment-spring/train.py -v`\nReal pendulum: `python3 experiment-real/train.py -v`"
    files, _ = mapped(spark, two, ["experiment-spring/train.py", "experiment-real/train.py", "hnn.py"], readme=readme)
    assert files["SPRING"]["experiment-spring/train.py"].relevance_status == files["REAL"]["experiment-real/train.py"].relevance_status == "RELEVANT"
    assert files["SPRING"]["experiment-real/train.py"].relevance_status == "POSSIBLY_RELEVANT"


def test_doubt_and_missing_repositories(spark):
    one = [("E", "Evaluate on GLUE", "GLUE", "Net", None)]
    files, maps = mapped(spark, one, ["glue_train.py"], status="AMBIGUOUS", readme=None)
    assert files["E"]["glue_train.py"].relevance_status == "POSSIBLY_RELEVANT" and maps["E"].readiness == "LIMITED"
    files, maps = mapped(spark, one, ["other.py"], readme=None)
    assert files == {} and maps == {}
    files, maps = mapped(spark, one, [], accessible=False)
    assert files == {} and maps["E"].readiness == "MISSING" and "EVALUATION" in maps["E"].missing_roles
    search = [("E", "Neural architecture search on GLUE", "GLUE", "Net", None)]
    files, _ = mapped(spark, search, ["glue_train.py", "nas_glue.py"], readme=None)
    assert (files["E"]["glue_train.py"].relevance_status, files["E"]["nas_glue.py"].relevance_status) == ("POSSIBLY_RELEVANT", "RELEVANT")


def test_links_are_found_once(spark):
    from quillstone.operators import discovery

    papers = spark.createDataFrame([("c", "see https://x.org/a, and more"), ("n", None)], "case_id string, text string").repartition(2)
    found = discovery.links(papers)
    # No filter that finds all links beforehand, to see whether there are any.
    assert "(size(filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.case_id, r.url) for r in found.collect()] == [("c", "https://x.org/a")]
