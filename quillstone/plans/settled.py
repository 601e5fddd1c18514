"""Queries of jobs and cancellations, exact rounding, people's names, merged references and verification (DM09, DM11, F18, JN11, SC81, SC90, TVF03, TVF06, TVF14, WN08, WN09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import artifacts, citations, numbers, people, rules
from quillstone.functions.spread import spread
from quillstone.operators import clustering, jobs, matching
from quillstone.plans.registry import query
from quillstone.plans.tables import table


@query("sc90_exact_round", """
SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice::DOUBLE * l_discount::DOUBLE)::DOUBLE AS two, printf('%.1f', l_quantity::DOUBLE / 4)::DOUBLE AS one, printf('%.4f', l_extendedprice::DOUBLE / 7)::DOUBLE AS four FROM lineitem""")
def sc90(spark, sf):
    price, discount, quantity = (F.col(c).cast("double") for c in ("l_extendedprice", "l_discount", "l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.exact_round(price * discount, 2).alias("two"), numbers.exact_round(quantity / 4, 1).alias("one"), numbers.exact_round(price / 7, 4).alias("four"))


@query("f18_staged_names", """
WITH p AS (SELECT p_partkey, ['src/', '.git/', '.ENV', 'credentials.json', 'data/.git/', '.config/gcloud/', '.config/', '.gitignore'][p_partkey % 8 + 1] || CASE WHEN p_partkey % 8 IN (2, 3, 7) THEN '' ELSE p_name END AS path, p_size % 9 = 0 AS symlink FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 8 IN (1, 2, 3, 5) THEN 'INVALID_TARGET' WHEN symlink THEN 'ARTIFACT_CHANGED' END AS fault FROM p""")
def f18_staged(spark, sf):
    k = F.col("p_partkey") % 8
    roots = F.array(*map(F.lit, ("src/", ".git/", ".ENV", "credentials.json", "data/.git/", ".config/gcloud/", ".config/", ".gitignore")))
    path = F.concat(F.element_at(roots, (k + 1).cast("int")), F.when(k.isin(2, 3, 7), "").otherwise(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", artifacts.staging_fault(path, F.col("p_size") % 9 == 0).alias("fault"))


@query("tvf03_unmerged_references", r"""
WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '[' || i || '] ' || x), ' ') AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, t, regexp_replace(t, '(^|[\s.>)\]"”’])(\[\d{1,3}\]\s*[A-ZÀ-ɏ"“])', '\1' || chr(1) || '\2', 'g') AS b, regexp_replace(t, '(^|[\s.>)\]"”’])(\d{1,3}\.\s+[A-ZÀ-ɏ"“])', '\1' || chr(1) || '\2', 'g') AS d FROM t),
c AS (SELECT doc_id, CASE WHEN len(string_split(b, chr(1))) > 2 THEN list_filter(list_transform(string_split(b, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 15) WHEN len(string_split(d, chr(1))) > 2 THEN list_filter(list_transform(string_split(d, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 15) ELSE [t] END AS r FROM m)
SELECT doc_id, len(r)::INTEGER AS n_references, md5(array_to_string(r, chr(10))) AS entries_md5 FROM c""")
def tvf03(spark, sf):
    """The lines of every document, numbered and merged, cut into references again where they start like ones."""
    merged = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), " ")
    r = spread(table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.explode(F.array(merged)).alias("merged"))
    # Arrays of one, exploded: what is in them is worked out once for each row.
    r = r.select("doc_id", F.explode(F.array(citations.unmerged(F.col("merged")))).alias("r"))
    return r.select("doc_id", F.size("r").alias("n_references"), F.md5(F.array_join("r", "\n")).alias("entries_md5"))


@query("tvf06_author_segments", r"""
WITH s AS (SELECT doc_id, regexp_replace(unnest(string_split(text, ',')), '^\s+|\s*[.,;]*\s*$', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, s, regexp_split_to_array(s, '\s+') AS w FROM s)
SELECT doc_id, count(*)::BIGINT AS n_segments, count(*) FILTER (WHERE length(s) BETWEEN 1 AND 60 AND (regexp_matches(s, '(?i)\bet al\b') OR regexp_matches(lower(s), 'association|organization|organisation|committee|institute|society|council|academy|commission|department|ministry|who|ieee|acm|iso|world health|united states')
  OR (regexp_matches(s, '^[A-Z][.\-a-zA-Z\x{300}-\x{36f}]*\s+((d''|de|del|van|von|da|la)\s+)?([\p{L}\p{N}_\-''\x{300}-\x{36f}]|\s)+$') AND len(w) <= 5 AND len(list_filter(w, lambda x: regexp_matches(x, '\p{Ll}') AND NOT regexp_matches(x, '\p{Lu}') AND x NOT IN ('d''', 'de', 'del', 'van', 'von', 'da', 'la'))) <= 1)
  OR regexp_matches(s, '^[\p{L}\p{N}_\-''\x{300}-\x{36f}]+(\s+[A-Z]\.?)+$') OR (regexp_matches(s, '^\p{Lu}[\p{L}\p{N}_\-''\x{300}-\x{36f}]*$') AND length(s) < 25)))::BIGINT AS n_authors FROM w GROUP BY 1""")
def tvf06(spark, sf):
    """The parts between commas of every document's whole text, and how many read as authors."""
    parts = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.split("text", ",").alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("n_segments"), F.size(F.filter("parts", people.reads_as_author)).cast("long").alias("n_authors"))


@query("wn09_author_clusters", """
WITH n AS (SELECT o_custkey, list(o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' ' || replace(o_orderpriority, '-', ' ') END || ' Lee' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1),
k AS (SELECT o_custkey, list_reduce(list_transform(names, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y = x[1] OR (string_split(y, ' ')[1] = string_split(x[1], ' ')[1] AND (list_has_all(string_split(lower(y), ' '), string_split(lower(x[1]), ' ')) OR list_has_all(string_split(lower(x[1]), ' '), string_split(lower(y), ' ')))))) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS kept FROM n)
SELECT o_custkey, array_to_string(kept, '; ') AS authors, len(kept)::INTEGER AS n_authors FROM k""")
def wn09(spark, sf):
    """The names on each customer's orders, read as a paper's authors by order, one for each person."""
    middle = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.regexp_replace("o_orderpriority", "-", " ")))
    name = F.concat("o_orderstatus", middle, F.lit(" Lee"))
    names = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", name.alias("name")))).alias("a"))
    kept = names.select("o_custkey", people.distinct_people(F.col("a.name")).alias("kept"))
    return kept.select("o_custkey", F.array_join("kept", "; ").alias("authors"), F.size("kept").alias("n_authors"))


@query("jn11_context_experiment")
def jn11(spark, sf):
    """Every turn with the assistant's turn of its conversation whose first three words or last word it names best."""
    c = table(spark, sf, "conversations").filter("text is not null")
    words = F.split(F.trim("text"), r"\s+")
    experiments = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("experiment"), F.col("turn").alias("at"), F.array_join(F.slice(words, 1, 3), " ").alias("dataset"), F.element_at(words, -1).alias("model"))
    return matching.associated(c.select("conv_id", "turn", "text"), experiments, "conv_id", "text", "experiment", "at", ["dataset", "model"]).select("conv_id", "turn", "experiment")


@query("dm09_job_leases", """
WITH r AS (SELECT l_orderkey, l_suppkey AS w, l_shipdate::DATE AS d FROM lineitem), f AS (SELECT l_orderkey, w, d FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY d, w) AS k FROM r) WHERE k = 1),
b AS (SELECT l_orderkey, l_suppkey AS w, max(l_shipdate::DATE) AS beat FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'O' THEN 'COMPLETED' WHEN f.w IS NULL THEN 'QUEUED' ELSE 'CLAIMED' END AS status, CASE WHEN o_orderstatus = 'O' THEN f.w END AS worker_id, CASE WHEN o_orderstatus = 'O' THEN strftime(f.d, '%Y-%m-%d') END AS claimed,
  CASE WHEN o_orderstatus = 'O' THEN strftime(coalesce(b.beat, f.d), '%Y-%m-%d') END AS heartbeat, CASE WHEN o_orderstatus = 'O' THEN strftime(coalesce(b.beat, f.d) + INTERVAL 1 DAY, '%Y-%m-%d') END AS expiry
FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey AND b.w = f.w""")
def dm09(spark, sf):
    """Open orders are queued jobs, their lines' suppliers ask for them, returned lines are heartbeats."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED").alias("status"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("worker_id"), F.to_date("l_shipdate").alias("at"), "l_returnflag")
    out = jobs.beaten(jobs.claimed(runs, lines, "INTERVAL 1 DAY"), lines.filter("l_returnflag = 'R'"), "INTERVAL 1 DAY")
    day = lambda c, to: F.date_format(c, "yyyy-MM-dd").alias(to)
    return out.select("run_id", "status", "worker_id", day("claimed_at", "claimed"), day("heartbeat_at", "heartbeat"), day("lease_expiry", "expiry"))


@query("dm11_cancel_requests", """
WITH q AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT -1 - s_suppkey FROM supplier)
SELECT run_id, CASE o_orderstatus WHEN 'F' THEN 'REFUSED' WHEN 'P' THEN 'UNCHANGED' WHEN 'O' THEN 'REQUESTED' ELSE 'UNKNOWN_RUN' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'CANCELLED' WHEN 'O' THEN 'CANCEL_REQUESTED' END AS status FROM q LEFT JOIN orders ON o_orderkey = run_id""")
def dm11(spark, sf):
    s = F.col("o_orderstatus")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(s == "F", "COMPLETED").when(s == "P", "CANCELLED").otherwise("RUNNING").alias("status"))
    asked = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return jobs.cancel(runs, asked.union(table(spark, sf, "supplier").select(-1 - F.col("s_suppkey"))))


@query("sc81_verification", """
WITH p AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS ready, bool_or(o_orderstatus = 'F') AS partly, bool_and(o_orderstatus = 'O') AS blocked FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_acctbal > 0 AS has, ['AI_ML', 'SOCIAL_SCIENCE', 'HUMANITIES', 'ENGINEERING', 'BIOLOGY', 'PHYSICS_CHEMISTRY', 'OTHER', 'UNKNOWN'][c_nationkey % 8 + 1] AS domain FROM customer)
SELECT c_custkey, CASE domain WHEN 'AI_ML' THEN 'COMPUTATIONAL_REPRODUCTION' WHEN 'SOCIAL_SCIENCE' THEN 'STATISTICAL_VERIFICATION,DOCUMENTARY_VERIFICATION,QUALITATIVE_EVIDENCE_REVIEW,HUMAN_EXPERT_VALIDATION' WHEN 'HUMANITIES' THEN 'DOCUMENTARY_VERIFICATION,QUALITATIVE_EVIDENCE_REVIEW,HUMAN_EXPERT_VALIDATION' WHEN 'OTHER' THEN 'DOCUMENTARY_VERIFICATION,HUMAN_EXPERT_VALIDATION' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'COMPUTATIONAL_REPRODUCTION,EXPERIMENTAL_VERIFICATION,DOCUMENTARY_VERIFICATION' END AS methods,
  CASE domain WHEN 'AI_ML' THEN CASE WHEN ready THEN 'COMPUTATIONALLY_REPRODUCIBLE' WHEN partly THEN 'PARTIALLY_VERIFIABLE' WHEN blocked THEN 'INACCESSIBLE' ELSE 'INSUFFICIENT_EVIDENCE' END WHEN 'SOCIAL_SCIENCE' THEN CASE WHEN has THEN 'PARTIALLY_VERIFIABLE' ELSE 'REQUIRES_HUMAN_VALIDATION' END WHEN 'HUMANITIES' THEN 'DOCUMENTARILY_VERIFIABLE' WHEN 'OTHER' THEN 'UNKNOWN' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PARTIALLY_VERIFIABLE' END AS status
FROM c LEFT JOIN p ON o_custkey = c_custkey""")
def sc81(spark, sf):
    """Customers as papers of a domain by nation, their orders as plans."""
    s = F.col("o_orderstatus")
    plans = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.when(s == "P", "READY_FOR_EXECUTION").when(s == "F", "PARTIALLY_READY").otherwise("BLOCKED")).alias("plans"))
    domains = F.array(*map(F.lit, (*rules.METHODS, "UNKNOWN")))
    c = table(spark, sf, "customer").join(plans, "c_custkey", "left").withColumn("domain", F.element_at(domains, (F.col("c_nationkey") % 8 + 1).cast("int")))
    return c.select("c_custkey", F.array_join(rules.verification_methods(F.col("domain")), ",").alias("methods"), rules.verification_status(F.col("domain"), F.coalesce("plans", F.array().cast("array<string>")), F.col("c_acctbal") > 0).alias("status"))


@query("tvf14_listed_references", r"""
WITH l AS (SELECT doc_id, list_concat(list_transform(range(1, 6), lambda k: '[Key0' || k || '] Fixed.'), list_transform(string_split(text, chr(10)), lambda x, i: '[Ab' || lpad((i % 100)::VARCHAR, 2, '0') || '] ' || x)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(l)::INTEGER AS n_references, md5(array_to_string(list_transform(l, lambda x: regexp_replace(x, '\s+$', '')), chr(10))) AS entries_md5 FROM l""")
def tvf14(spark, sf):
    """The lines of every document after five others, each with a key of letters, as a bibliography."""
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[Ab"), F.lpad(((i + 1) % 100).cast("string"), 2, "0"), F.lit("] "), x)), "\n")
    fixed = "".join(f"[Key0{k}] Fixed.\n" for k in range(1, 6))
    r = table(spark, sf, "documents").filter("text is not null").select("doc_id", citations.listed_references(F.concat(F.lit(f"References\n{fixed}"), lines)).alias("r"))
    return r.select("doc_id", F.size("r").alias("n_references"), F.md5(F.array_join("r", "\n")).alias("entries_md5"))


@query("wn08_experiment_clusters")
def wn08_experiments(spark, sf):
    """Turns as experiments of their conversation: the text is the objective, its first and last word are fields."""
    words = F.split(F.trim("text"), r"\s+")
    none = F.lit(None).cast("string")
    e = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("objective"), F.when(F.col("turn") % 3 != 0, F.element_at(words, 1)).alias("dataset"), none.alias("split"),
        F.when(F.col("turn") % 2 == 0, F.element_at(words, -1)).alias("model"), F.col("role").alias("metric"), none.alias("baseline"), none.alias("reported_result"),
    )
    return clustering.experiment_clusters(e, "conv_id", "turn").select("conv_id", "cluster", "n", "dataset", "model", "metric", F.md5("objective").alias("objective_md5"))
