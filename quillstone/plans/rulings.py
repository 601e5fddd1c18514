"""Queries of rules, dependency files and bounded texts over the columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import artifacts, canonical, context, dependencies, environment, rules
from quillstone.operators import filters, state
from quillstone.plans.registry import query
from quillstone.plans.tables import table

#: The priority of an order as the status of an artifact, in SQL.
ARTIFACT = "CASE left(o_orderpriority, 1) WHEN '2' THEN 'MISSING' WHEN '3' THEN 'INACCESSIBLE' WHEN '4' THEN 'AMBIGUOUS' WHEN '5' THEN 'FOUND' END"


def _artifact():
    return F.expr(ARTIFACT)


@query("sc77_requirement_status", f"SELECT o_orderkey, CASE WHEN a IS NULL OR a = 'MISSING' THEN 'MISSING' WHEN a = 'FOUND' THEN 'AVAILABLE' WHEN a = 'AMBIGUOUS' THEN 'UNKNOWN' ELSE a END AS status FROM (SELECT o_orderkey, {ARTIFACT} AS a FROM orders)")
def sc77(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", rules.requirement_status(_artifact()).alias("status"))


@query("sc79_target_readiness", f"""
WITH n AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity > 40) AS gone, bool_or(l_discount > 0.09) AS missing, count(*) FILTER (l_linestatus = 'O') > 2 AS conflicts FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'UNKNOWN' WHEN left(o_orderpriority, 1) IN ('1', '2', '3') OR gone THEN 'BLOCKED' WHEN missing OR conflicts THEN 'PARTIALLY_READY' ELSE 'READY_' || o_orderstatus END AS readiness
FROM orders JOIN n ON l_orderkey = o_orderkey""")
def sc79(spark, sf):
    """Readiness of every order with lines; the statuses of its lines are those of its data."""
    status = F.when(F.expr("l_returnflag = 'R' AND l_quantity > 40"), "MISSING").otherwise("AVAILABLE")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(status).alias("needs"), F.bool_or(F.col("l_discount") > 0.09).alias("missing"), (F.count_if(F.col("l_linestatus") == "O") > 2).alias("conflicts"))
    o = table(spark, sf, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    ready = rules.target_readiness(F.col("o_totalprice") > 50000, _artifact(), F.col("needs"), F.col("missing"), F.col("conflicts"), F.concat(F.lit("READY_"), "o_orderstatus"))
    return o.select("o_orderkey", ready.alias("readiness"))


@query("f21_eligible_target", "SELECT p_partkey, p_size % 2 = 0 AND p_type <> 'SMALL' AND p_size > 5 AND p_retailprice > 901 AS eligible FROM part")
def f21(spark, sf):
    c = F.col
    ok = rules.eligible_target(c("p_name"), F.when(c("p_size") % 2 == 0, c("p_brand")), F.when(c("p_type") != "SMALL", c("p_type")).otherwise(" "), c("p_size") > 5, F.when(c("p_retailprice") > 901, c("p_retailprice")))
    return table(spark, sf, "part").select("p_partkey", ok.alias("eligible"))


@query("sc84_review_required", "SELECT o_orderkey, o_orderstatus = 'P' OR left(o_orderpriority, 1) IN ('4', '5') AS review FROM orders")
def sc84(spark, sf):
    support = F.when(F.col("o_orderstatus") == "P", "CONTRADICTED").otherwise("SUPPORTED")
    confidence = F.when(F.col("o_orderpriority").startswith("5"), "LOW").when(F.col("o_orderpriority").startswith("4"), "UNKNOWN").otherwise("HIGH")
    return table(spark, sf, "orders").select("o_orderkey", rules.review_required(support, confidence).alias("review"))


@query("sc85_corrected_support", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' OR (l_returnflag = 'R' AND l_quantity < 10) THEN 'UNCLEAR' WHEN l_returnflag = 'R' THEN 'NOT_SUPPORTED' ELSE 'SUPPORTED' END AS support FROM lineitem")
def sc85(spark, sf):
    support = F.when(F.col("l_returnflag") == "N", "SOURCE_UNAVAILABLE").when(F.col("l_returnflag") == "R", "NOT_SUPPORTED").otherwise("SUPPORTED")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.corrected_support(support, F.col("l_quantity") < 10).alias("support"))


@query("sc87_investigation", "SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'NO_DISCREPANCY' WHEN 'error' THEN 'BLOCKED' WHEN 'click' THEN 'DETECTED' ELSE 'INCONCLUSIVE' END AS status FROM events) GROUP BY 1")
def sc87(spark, sf):
    compared = F.when(F.col("event_type") == "purchase", "VERIFIED").when(F.col("event_type") == "error", "BLOCKED").when(F.col("event_type") == "click", "NOT_REPRODUCED").otherwise("PARTIALLY_REPRODUCED")
    return table(spark, sf, "events").groupBy(rules.investigation_status(compared).alias("status")).agg(F.count("*").alias("n"))


@query("sc88_report_status", """
WITH l AS (SELECT l_orderkey, bool_and(l_returnflag = 'A') AS verified, bool_or(l_quantity > 49) AS env, bool_or(l_discount > 0.095) AS issues, bool_or(l_tax > 0.07) AS open, bool_or(l_linestatus = 'O') AS partly FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN env THEN 'BLOCKED' WHEN issues THEN 'INCONCLUSIVE' WHEN verified AND open THEN 'INCONCLUSIVE' WHEN verified AND partly THEN 'PARTIALLY_REPRODUCED' WHEN verified THEN 'VERIFIED' ELSE 'NOT_REPRODUCED' END AS status FROM l""")
def sc88(spark, sf):
    some = lambda e: F.bool_or(F.expr(e))
    rolled = F.when(F.bool_and(F.col("l_returnflag") == "A"), "VERIFIED").otherwise("NOT_REPRODUCED")
    status = rules.report_status(rolled, some("l_quantity > 49"), some("l_discount > 0.095"), some("l_tax > 0.07"), some("l_linestatus = 'O'"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(status.alias("status"))


@query("sc64_explicit_route", """
WITH r AS (SELECT l_orderkey, min(l_partkey) FILTER (l_returnflag = 'A') AS a, min(l_partkey) FILTER (l_returnflag = 'N') AS n, min(l_partkey) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN a IS NOT NULL THEN 'crossref' WHEN n IS NOT NULL THEN 'openalex' ELSE 'scopus' END AS provider, coalesce(a, n, r) AS work FROM r""")
def sc64(spark, sf):
    """The record of the first registry that has one, a registry for each return flag."""
    of = lambda flag, name: (F.min(F.when(F.col("l_returnflag") == flag, F.col("l_partkey"))).alias(name))
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of("A", "crossref"), of("N", "openalex"), of("R", "scopus"))
    record = lambda p: F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("provider"), F.col(p).alias("work")))
    return r.select("l_orderkey", rules.first_of_registries(record("crossref"), record("openalex"), record("scopus")).alias("m")).select("l_orderkey", "m.provider", "m.work")


@query("sc65_missing_route", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'DOI_MISSING' WHEN l_linestatus = 'F' THEN 'WORK_FOUND_NO_DOI' WHEN l_linenumber > 4 OR l_discount * 10 < 0.8 THEN 'DOI_MISSING' ELSE 'RECOVERED' END AS route FROM lineitem""")
def sc65(spark, sf):
    doi = F.when(F.col("l_linestatus") != "F", F.concat(F.lit("10.1000/"), F.col("l_partkey").cast("string")))
    route = rules.missing_identifier_route(F.col("l_returnflag") != "R", doi, F.col("l_linenumber") > 4, F.col("l_discount") * 10)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", route.alias("route"))


FILES = "CASE p_size % 10 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN p_brand || '.yaml' WHEN 3 THEN 'train.py' WHEN 4 THEN p_name || '.pth' WHEN 5 THEN 'my_config.py' WHEN 6 THEN 'README.md' WHEN 7 THEN 'environment.yml' WHEN 8 THEN 'requirements-dev.txt' ELSE p_type || '.bash' END"


@query("sc72_file_type", f"""
SELECT p_partkey, CASE WHEN f IN ('requirements.txt', 'environment.yml') THEN 'DEPENDENCY' WHEN f = 'dockerfile' THEN 'CONTAINER' WHEN f LIKE '%.yaml' OR f LIKE '%config%' THEN 'CONFIG' WHEN f LIKE '%.bash' OR f = 'train.py' THEN 'EXECUTION_SCRIPT' WHEN f LIKE '%.pth' THEN 'CHECKPOINT' END AS kind
FROM (SELECT p_partkey, lower({FILES}) AS f FROM part)""")
def sc72(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rules.file_type(F.concat(F.lit("src/"), F.expr(FILES))).alias("kind"))


@query("wn12_evidence_order", f"""
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY r, lower(f), p_partkey)::BIGINT AS read_at FROM (SELECT *, CASE WHEN f = 'requirements.txt' THEN 0 WHEN f = 'requirements-dev.txt' THEN 1 WHEN f = 'environment.yml' THEN 2 WHEN f = 'Dockerfile' THEN 9 WHEN f = 'README.md' THEN 13 ELSE 12 END AS r FROM (SELECT p_partkey, p_brand, {FILES} AS f FROM part))""")
def wn12(spark, sf):
    """The order in which the files of each brand are read."""
    from pyspark.sql import Window

    path = F.expr(FILES)
    w = Window.partitionBy("p_brand").orderBy(dependencies.file_rank(path), F.lower(path), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("read_at"))


@query("f16_artifact_links", "SELECT page_id, page_id % 3 = 0 OR length(url) % 2 = 0 AS of_paper FROM pages")
def f16(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://ArXiv.org/abs/"), F.col("page_id").cast("string"))).when(F.length("url") % 2 == 0, F.concat(F.lit("http://doi.org/10.1/"), F.length("url").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", rules.of_paper_host(url).alias("of_paper"))


@query("f15_citing_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_suppkey < 1900 THEN 2 ELSE 1 END::INTEGER AS n_keys FROM lineitem")
def f15(spark, sf):
    around = F.when(F.col("l_returnflag") == "A", "as in Equation (3) above").otherwise("as shown before (3, 7).")
    keys = F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey").cast("long"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(rules.citing_numbers(around, keys)).alias("n_keys"))


@query("prj10_picked_text", """
SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.ref')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), nullif(trim(json_extract_string(props, '$.v')), '')) AS picked FROM events""")
def prj10(spark, sf):
    return table(spark, sf, "events").select("event_id", rules.picked_text(F.col("props"), "ref", "k", "v").alias("picked"))


@query("prj14_located", "SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN role ELSE 'chunk-' || conv_id END AS location FROM conversations")
def prj14(spark, sf):
    own = F.when(F.length("text") % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(rules.located(own, F.concat(F.lit("chunk-"), F.col("conv_id").cast("string"))), ",").alias("location"))


@query("prj15_protocol_split", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' AND o_orderpriority >= '3' THEN 'test' END AS split FROM orders")
def prj15(spark, sf):
    c = F.col
    text = F.when(c("o_orderstatus") == "O", "We used the standard train / test splits of all data.").otherwise("Splits are our own.")
    aim = F.when(c("o_orderpriority") >= "3", "accuracy in Testing").otherwise("accuracy, attested")
    return table(spark, sf, "orders").select("o_orderkey", rules.split_of_protocol(F.when(c("o_orderstatus") == "F", "train"), text, aim, F.lit(None).cast("string")).alias("split"))


@query("jn12_repository_relation", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'PARTIAL' WHEN p_type = 'PROMO' THEN 'AMBIGUOUS' WHEN p_type = 'LARGE' OR p_size >= 40 THEN 'VERIFIED' ELSE 'FOUND' END AS relation, CASE WHEN p_size < 10 OR p_type = 'PROMO' THEN 'LOW' WHEN p_type = 'LARGE' OR p_size >= 40 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM part""")
def jn12(spark, sf):
    around = F.when(F.col("p_type") == "PROMO", "an Unofficial port of our code").when(F.col("p_type") == "LARGE", "Our implementation is at").otherwise("see also")
    r = rules.repository_relation(F.col("p_size") >= 10, around, F.when(F.col("p_size") >= 40, 95.0).otherwise(50.0), F.lit(False))
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.relation", "r.confidence")


@query("jn18_command_fits", """
SELECT l_orderkey, l_linenumber, l_partkey, fits FROM (SELECT l.*, split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND (a.p_size % 5 > 0 OR l_quantity > 25) AND (l_linenumber % 3 > 0 OR a.p_size % 10 = b.p_size % 10) AS fits FROM lineitem l JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey)""")
def jn18(spark, sf):
    """Whether the command of a line's part can be an experiment of its supplier's part."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c[2:]}") for c in p.columns])
    x = table(spark, sf, "lineitem").join(side("a"), F.col("l_partkey") == F.col("a_partkey")).join(side("b"), F.col("l_suppkey") == F.col("b_partkey"))
    noun = lambda s: F.substring_index(f"{s}_name", " ", -1)
    size = lambda s: (F.col(f"{s}_size") % 10).cast("string")
    model = F.when(F.col("a_size") % 5 == 0, " --model net").otherwise("")
    command = F.concat(F.lit("python train.py --dataset="), F.upper(noun("a")), model, F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" --ipc "), size("a"))).otherwise(""))
    fits = rules.command_fits(command, F.concat(F.lit("accuracy at "), size("b"), F.lit(" images per class")), noun("b"), F.when(F.col("l_quantity") > 25, "Net-5"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", fits.alias("fits"))


@query("ag23_author_year", """
WITH l AS (SELECT l_orderkey, l_returnflag, split_part(p_name, ' ', 1) || '_' || (1950 + p_size) AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name IS NOT NULL),
c AS (SELECT l_orderkey, coalesce(list_distinct(list(k) FILTER (l_returnflag <> 'A')), []) AS cited, coalesce(list_distinct(list(k) FILTER (l_returnflag <> 'R')), []) AS listed, count(*) FILTER (l_returnflag <> 'R') AS n FROM l GROUP BY 1),
d AS (SELECT *, len(list_filter(listed, lambda x: NOT list_contains(cited, x)))::INTEGER AS n_orphans, len(list_filter(cited, lambda x: NOT list_contains(listed, x)))::INTEGER AS n_missing FROM c)
SELECT l_orderkey, n_orphans, n_missing, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - (1.5::DOUBLE * n_orphans + 3 * n_missing) / greatest(1, n) * 100)), 1) AS score FROM d""")
def ag23(spark, sf):
    """Author-year keys that each order cites and lists: markers '(Cold, 1987)' against entries 'Ann Cold; others'."""
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part").filter("p_name IS NOT NULL"), F.col("p_partkey") == F.col("l_partkey"))
    name, year = F.initcap(F.substring_index("p_name", " ", 1)), F.col("p_size") + 1950
    cited = rules.author_year_cited(F.concat(F.lit("("), name, F.lit(" et al., "), year.cast("string"), F.lit(")")), F.concat(name, F.lit(" et al.")))
    listed = rules.author_year_listed(F.concat(F.lit("Ann "), name, F.lit(", A.; Lee, B.")), year)
    in_list = F.col("l_returnflag") != "R"
    g = x.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "A", cited)).alias("c"), F.collect_set(F.when(in_list, listed)).alias("l"), F.count_if(in_list).alias("n"))
    return g.select("l_orderkey", rules.author_year_consistency(F.col("c"), F.col("l"), F.col("n")).alias("r")).select("l_orderkey", F.size("r.orphans").alias("n_orphans"), F.size("r.missing").alias("n_missing"), "r.score")


@query("sc23_document_identifier", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '10.1234/p' || page_id WHEN page_id % 3 = 0 THEN '10.5555/t' || page_id END AS doi FROM pages")
def sc23(spark, sf):
    k = F.col("page_id").cast("string")
    links = F.array("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1234/p"), k)).otherwise(F.lit("https://example.org")))
    return table(spark, sf, "pages").select("page_id", rules.document_identifier(links, F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("A title\ndoi: 10.5555/t"), k))).alias("doi"))


def _files(spark, sf, content: str, declared) -> DataFrame:
    """Dependencies of one file for each supplier; {n}, {k} and {w} stand for its nation, key and a name."""
    text = F.lit(content)
    for mark, c in (("{n}", F.col("s_nationkey").cast("string")), ("{k}", F.col("s_suppkey").cast("string")), ("{w}", F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")))):
        text = F.replace(text, F.lit(mark), c)
    return table(spark, sf, "supplier").select("s_suppkey", F.posexplode(declared(text)).alias("position", "d")).select("s_suppkey", "position", "d.name", "d.version_constraint")


def _sql(*rows: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT s_suppkey, {i}::INTEGER AS position, {n} AS name, {c}::VARCHAR AS version_constraint FROM supplier" for i, (n, c) in enumerate(rows))


@query("tvf19_conda", _sql(("'python'", "'==3.' || s_nationkey"), ("'numpy'", "NULL"), ("'scipy'", "'>=1.' || s_nationkey"), ("'pkg' || s_suppkey", "'[gpu]==2'"), ("'torch'", "'==2.' || s_suppkey")))
def tvf19_conda(spark, sf):
    text = "name: x\nchannels:\n  - main\ndependencies:\n  - python=3.{n}=build_0\n  - numpy\n  # none\n  - scipy>=1.{n}\n  - pip:\n    - {w}[gpu] == 2\n    - -e .\n  - torch=2.{k}\nprefix: /y\n"
    return _files(spark, sf, text, dependencies.conda)


@query("tvf19_pyproject", _sql(("'python'", "'>=3.' || s_nationkey"), ("'pkg' || s_suppkey", "'~=1.0,<2; python_version > \"3\"'"), ("'requests'", "'^2.' || s_nationkey"), ("'any'", "NULL"), ("'lint'", "'1.' || s_suppkey"), ("'setuptools'", "'>=61'")))
def tvf19_pyproject(spark, sf):
    text = """[project]
requires-python = ">=3.{n}"
dependencies = ["{w} ~= 1.0, < 2 ; python_version > \\"3\\"", "not a requirement"]
[tool.poetry.dependencies]
requests = {version = "^2.{n}"}
any = "*"
local = {path = "x"}
[tool.poetry.group.dev.dependencies]
lint = "1.{k}"
[build-system]
requires = ["setuptools>=61"]
"""
    return _files(spark, sf, text, lambda c: dependencies.declared(c, "pyproject.toml"))


@query("tvf19_pipfile", _sql(("'python'", "'==3.' || s_nationkey"), ("'pkg' || s_suppkey", "NULL"), ("'requests'", "'>=2'")))
def tvf19_pipfile(spark, sf):
    return _files(spark, sf, '[requires]\npython_version = "3.{n}"\n[packages]\n{w} = "*"\n[dev-packages]\nrequests = {version = ">=2"}\n', lambda c: dependencies.declared(c, "pipfile"))


@query("tvf19_lock_files", "SELECT * FROM (" + _sql(("'pkg' || s_suppkey", "'==1.' || s_nationkey"), ("'tool'", "'==' || s_suppkey")) + ") UNION ALL SELECT s_suppkey, 100::INTEGER, 'pkg' || s_suppkey, '==3.' || s_nationkey FROM supplier")
def tvf19_lock_files(spark, sf):
    a = _files(spark, sf, '{"default": {"{w}": {"version": "==1.{n}"}, "git": {"ref": "x"}}, "develop": {"tool": {"version": "=={k}"}}}', lambda c: dependencies.declared(c, "pipfile.lock"))
    b = _files(spark, sf, '[[package]]\nname = "{w}"\nversion = "3.{n}"\n[[package]]\nversion = "1"\n', lambda c: dependencies.declared(c, "poetry.lock"))
    return a.unionByName(b.withColumn("position", F.col("position") + 100))


@query("tvf19_setup_cfg", _sql(("'python'", "'>=3.' || s_nationkey"), ("'numpy'", "'>=1.' || s_nationkey"), ("'pkg' || s_suppkey", "NULL")))
def tvf19_setup_cfg(spark, sf):
    return _files(spark, sf, "[metadata]\nname = x\n[options]\npython_requires = >=3.{n}\ninstall_requires =\n    numpy>=1.{n}\n    {w}\n", lambda c: dependencies.declared(c, "setup.cfg"))


@query("tvf10_large_text")
def tvf10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(context.large_text(F.col("text"), 400)).alias("piece", "text"))
    return d.select("doc_id", "piece", "text")


@query("tvf13_bounded_text")
def tvf13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", context.bounded_text(F.col("text"), 1000).alias("text"))


@query("tvf15_reference_fields", """
SELECT p_partkey, upper(left(p_name, 1)) || p_name[2:] || ' and its ' || p_type AS title, 'A. Smith|Bo Lee|C. D. ' || p_type AS authors FROM part WHERE p_name IS NOT NULL""")
def tvf15(spark, sf):
    title = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000), F.lit(" and its "), "p_type")
    mark = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("] "))).otherwise("")
    year = F.when(F.col("p_size") % 2 == 0, "").otherwise(", 2019b")
    raw = F.concat(mark, F.lit("A. Smith, Bo  Lee, and C. D. "), "p_type", F.lit(".\n"), title, year, F.lit(". Journal of things, 3(2)."))
    f = table(spark, sf, "part").filter("p_name IS NOT NULL").select("p_partkey", context.reference_fields(raw).alias("f"))
    return f.select("p_partkey", "f.title", F.array_join("f.authors", "|").alias("authors"))


@query("sc80_environment_status", """
WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS facts, count(*) FILTER (l_quantity > 45) AS conflicts, count(*) FILTER (l_linestatus = 'O') AS missing, bool_or(l_tax > 0.01) AS open FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN NOT open THEN 'BLOCKED' WHEN facts = 0 THEN 'UNKNOWN' WHEN conflicts = 0 AND missing = 0 THEN 'RECONSTRUCTED' ELSE 'PARTIALLY_RECONSTRUCTED' END AS status FROM l""")
def sc80(spark, sf):
    n = lambda e: F.count_if(F.expr(e))
    status = artifacts.environment_status(n("l_returnflag = 'A'"), n("l_quantity > 45"), n("l_linestatus = 'O'"), F.bool_or(F.col("l_tax") > 0.01))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(status.alias("status"))


@query("so08_missing_roles", """
SELECT p_partkey, (2 + (p_size > 10)::INT + (p_type <> 'SMALL')::INT)::INTEGER AS n_missing FROM part""")
def so08(spark, sf):
    """Roles that a part's experiment expects and its files, which have two of them, do not fill."""
    wanted = artifacts.expected_roles(F.when(F.col("p_size") > 10, F.col("p_name")), F.when(F.col("p_type") != "SMALL", F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_except(wanted, F.array(F.lit("EVALUATION"), F.lit("CHECKPOINT")))).alias("n_missing"))


@query("sc99_manifest_hash", """
SELECT l_orderkey, sha256(string_agg(lpad(strlen(path)::VARCHAR, 8, '0') || path || h, '' ORDER BY path, h)) AS manifest FROM (SELECT l_orderkey, l_linenumber || '/' || l_partkey || '.bin' AS path, sha256(l_suppkey::VARCHAR) AS h FROM lineitem) GROUP BY 1""")
def sc99(spark, sf):
    path = F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".bin"))
    files = F.collect_list(F.struct(path.alias("path"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("sha256")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(canonical.manifest_hash(files).alias("manifest"))


@query("jn27_lookups", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, o_orderstatus FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey")
def jn27(spark, sf):
    """Lines with what their keys stand for; keys that stand for nothing keep their line."""
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    for which, own, key, value in (("part", "l_partkey", "p_partkey", "p_name"), ("supplier", "l_suppkey", "s_suppkey", "s_name"), ("orders", "l_orderkey", "o_orderkey", "o_orderstatus")):
        known = table(spark, sf, which).select(F.col(key).alias(own), value)
        out = out.join(known, own, "left")
    return out


@query("cl06_table_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority ILIKE '%URG%' OR o_orderkey::VARCHAR ILIKE '%URG%')")
def cl06(spark, sf):
    o = table(spark, sf, "orders").withColumn("key_text", F.col("o_orderkey").cast("string"))
    return filters.faceted(o, "urg", ["o_orderpriority", "key_text"], {"o_orderstatus": "F"}).select("o_orderkey")


@query("hl06_citation_keys", """
SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_partkey END) || '|' || lower(p_brand) || '_' || p_size || '|' || lower(p_brand) || '_2000|' || lower(p_type) || '_' || p_size || '|' || lower(p_type) || '_2000' AS keys FROM part""")
def hl06(spark, sf):
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ["), F.col("p_size").cast("string"), F.lit("] A work"))).otherwise("A work")
    keys = rules.citation_keys(number, F.col("p_partkey"), F.array("p_brand", "p_type"), F.array(F.col("p_size").cast("long"), F.lit(2000).cast("long")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys, "|").alias("keys"))


@query("hl16_normal_version", "SELECT p_partkey, lower(p_brand) || '.' || p_size AS version FROM part")
def hl16(spark, sf):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("==", ">= ", "~=", "^", "!=", "")]), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", environment.normal_version(F.concat(mark, "p_brand", F.lit("."), F.col("p_size").cast("string"))).alias("version"))


@query("prj02_output_rows", """
SELECT l_orderkey, round(max(l_quantity) / 7, 3) AS score, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags, CASE WHEN bool_or(l_linestatus = 'O') THEN 'True' ELSE 'False' END AS open FROM lineitem GROUP BY 1""")
def prj02(spark, sf):
    """Rows as exports have them: scores of three places, lists joined, booleans as words."""
    open_ = rules.python_bool(F.bool_or(F.col("l_linestatus") == "O"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.max("l_quantity") / 7, 3).alias("score"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"), open_.alias("open"))


@query("dm05_guarded_refresh", """
SELECT n_nationkey AS key, 'nation' AS kind FROM nation UNION ALL SELECT o_custkey, 'old' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE (SELECT count(DISTINCT o_custkey) FROM orders) >= 100
UNION ALL SELECT r_regionkey, 'new' FROM region WHERE (SELECT count(DISTINCT o_custkey) FROM orders) < 100""")
def dm05(spark, sf):
    """A small table that is refreshed and one that is too large to be, one under the other."""
    rows = lambda which, key, kind: table(spark, sf, which).select(F.col(key).cast("long").alias("key"), F.lit(kind).alias("kind")).distinct()
    old, new = rows("orders", "o_custkey", "old"), rows("region", "r_regionkey", "new")
    return state.guarded_refresh(rows("region", "r_regionkey", "region"), rows("nation", "n_nationkey", "nation"), 100).unionByName(state.guarded_refresh(old, new, 100))
