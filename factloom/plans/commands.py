"""Queries on lifecycle commands, supersession, rebased relations and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import commands
from factloom.plans import views

#: An own lexicon of concepts for the given tables' texts.
CONCEPTS = {"contact": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "emphasis": r"!!|\*\*\*|###", "licence": "(?i)licen[sc]e|rights reserved", "list": r" \| ", "number": "[0-9]{4,}"}


def lifecycle_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as commands on its fact."""
    facts = views.facts(spark, sf_dir).select("fact_id", F.when(F.col("status") == "active", "active").otherwise("archived").alias("status"), "value")
    li = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").cast("long").alias("seq")).agg(F.min("l_partkey").alias("p"))
    k = F.col("p") % 7
    kind = F.when(k < 3, "edit").when(k == 3, "suppress").when(k == 4, "restore").when(k == 5, "delete").otherwise(F.when(F.col("p") % 5 == 0, "purge").otherwise("archive"))
    done = commands.applied_commands(facts, li.select("fact_id", "seq", kind.alias("command"), F.concat(F.lit("v"), F.col("p")).alias("value")))
    return done.groupBy("command", "status").agg(F.count("*").alias("n"), F.max("version").alias("versions"), F.count_distinct("event_key").alias("keys"))


LIFECYCLE_COMMANDS = f"""WITH {views.FACTS}, f AS (SELECT fact_id, CASE WHEN status = 'active' THEN 'active' ELSE 'archived' END AS st FROM v_fact),
l AS (SELECT l_orderkey AS fact_id, l_linenumber AS seq, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
c AS (SELECT fact_id, seq, st, CASE WHEN p % 7 < 3 THEN 'edit' WHEN p % 7 = 3 THEN 'suppress' WHEN p % 7 = 4 THEN 'restore' WHEN p % 7 = 5 THEN 'delete' WHEN p % 5 = 0 THEN 'purge' ELSE 'archive' END AS command FROM l JOIN f USING (fact_id)),
p AS (SELECT *, min(CASE WHEN command = 'purge' THEN seq END) OVER (PARTITION BY fact_id) AS ps, CASE command WHEN 'suppress' THEN 'suppressed' WHEN 'delete' THEN 'deleted' WHEN 'purge' THEN 'purged' WHEN 'restore' THEN 'active' WHEN 'archive' THEN 'archived' END AS af FROM c),
s AS (SELECT *, coalesce(last_value(af IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS UNBOUNDED PRECEDING), st) AS status, coalesce(last_value(af IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st) AS before FROM p WHERE ps IS NULL OR seq <= ps),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY seq) + 1 AS INTEGER) AS version FROM s WHERE NOT (command = 'restore' AND before = 'active'))
SELECT command, status, count(*) AS n, max(version) AS versions, count(*) AS keys FROM k GROUP BY command, status"""


def supersession_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles among parts by their first lines: each order's first part is superseded by its last one."""
    li = views.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("src"), F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("dst"))
    first = li.where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    return commands.cyclic(first)


SUPERSESSION_CYCLES = """WITH RECURSIVE l AS (SELECT arg_min(l_partkey, (l_linenumber, l_partkey)) AS src, arg_max(l_partkey, (l_linenumber, l_partkey)) AS dst FROM lineitem GROUP BY l_orderkey),
e AS (SELECT src, min(dst) AS dst FROM l WHERE src <> dst GROUP BY src),
dead(node) AS (SELECT dst FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src FROM dead JOIN e ON e.dst = dead.node)
SELECT src AS node FROM e WHERE src NOT IN (SELECT node FROM dead)"""


def relation_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between an order's claims, against claims of which some went and some changed."""
    c = views.claims(spark, sf_dir).groupBy("id").agg(F.min("subject").alias("s"))
    rel = c.select(F.col("id").alias("a"), F.col("s").alias("a_hash")).join(c.select(F.col("id").alias("b"), F.col("s").alias("b_hash")), F.col("b") == F.col("a") + 1)
    now = c.where("id % 11 <> 0").select("id", F.when(F.col("id") % 13 == 0, -F.col("s")).otherwise(F.col("s")).alias("hash"))
    return commands.rebased(rel.withColumn("relation_id", F.col("a")), now).groupBy("action", "reason").agg(F.count("*").alias("n"), F.min("relation_id").alias("first_id"))


RELATION_REBASE = f"""WITH {views.CLAIMS}, c AS (SELECT id, min(subject) AS s FROM v_claim GROUP BY id), n AS (SELECT id, CASE WHEN id % 13 = 0 THEN -s ELSE s END AS h FROM c WHERE id % 11 <> 0),
r AS (SELECT x.id AS a, y.id AS b, x.s AS ah, y.s AS bh FROM c x JOIN c y ON y.id = x.id + 1),
j AS (SELECT a, CASE WHEN p.h IS NULL OR q.h IS NULL THEN 'missing-end' WHEN ah <> p.h OR bh <> q.h THEN 'changed-end' END AS reason FROM r LEFT JOIN n p ON p.id = a LEFT JOIN n q ON q.id = b)
SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'purged' END AS action, reason, count(*) AS n, min(a) AS first_id FROM j GROUP BY reason"""


def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(commands.concepts(F.col("text"), CONCEPTS), ",").alias("concepts"))


CONCEPT_TAGS = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in sorted(CONCEPTS.items())) + "], lambda c: c IS NOT NULL), ',') AS concepts FROM documents"

QUERIES = {f.__name__: f for f in (lifecycle_commands, supersession_cycles, relation_rebase, concept_tags)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
