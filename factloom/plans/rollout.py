"""Queries on the gate between flat hybrid recall and hierarchical recall, on what the customers of the tables ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import hierarchical as tiers
from factloom.operators import hybrid as flat
from factloom.operators import rollout, tables
from factloom.plans import hierarchical, hybrid

#: What some questions ask for: keys of facts; none where there is no answer. Rows handed out by each strategy.
ANSWERS = {1: ("profile.name",), 2: ("profile.location",), 4: (), 5: (), 8: ("health.allergy", "relationship.pet_name"), 12: (), 13: ("routine.weekend",)}
K = 5


def _cases(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Relevant facts are the active ones of the keys asked for, forbidden ones those that were superseded."""
    n = F.col("request_id") % len(hybrid.QUESTIONS)
    keys = F.coalesce(*(F.when(n == q, F.array(*map(F.lit, k)).cast("array<string>")) for q, k in ANSWERS.items()))
    cases = asked.select(F.col("request_id").alias("case_id"), "owner", keys.alias("keys")).where("keys IS NOT NULL")
    each = cases.select("case_id", "owner", F.explode_outer("keys").alias("key"))
    role = F.when(F.col("status") == "active", "relevant").when(F.col("status") == "superseded", "forbidden")
    met = each.join(facts.select("owner", "key", F.col("id").alias("fact_id"), role.alias("role")), ["owner", "key"], "left")
    return met.select("case_id", "fact_id", "role")


def rollout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of hierarchical recall against flat recall. The cases are made, so that their purpose isn't trusted."""
    held = tables.keyed(hierarchical.facts(spark, sf_dir), "facts-gate")
    asked = flat.planned(hybrid.requests(spark, sf_dir))
    cases = tables.keyed(_cases(asked, held), "cases")
    none = F.lit(False).alias("failed")
    old = flat.recalled(asked, flat.index(held)).where(F.col("rank") <= K).select(F.col("request_id").alias("case_id"), F.col("id").alias("fact_id"), "rank", none)
    new = tiers.recalled(tiers.routed(asked), tiers.Index(held, hierarchical.summaries(held))).where(F.col("rank") <= K).select(F.col("request_id").alias("case_id"), F.col("id").alias("fact_id"), "rank", none)
    return rollout.gate(rollout.report(rollout.outcomes(cases, old, "a"), rollout.outcomes(cases, new, "b")), F.lit(False))


_KEYS = ", ".join(f"({q}, {k!r})" for q, keys in ANSWERS.items() for k in keys)
_ASKED = ", ".join(map(str, ANSWERS))
_P = rollout.POLICY


def _wilson(part: str, low: bool) -> str:
    n, s, z = f"{part}_n", f"{part}_sum", rollout.Z
    centre, spread = f"(({s} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))", f"({z} * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {spread}) ELSE 0.0 END" if low else f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {spread}) ELSE 1.0 END"


_SUMS = ", ".join(f"coalesce(sum(b_{m}), 0.0) AS {m}_sum, count(b_{m}) AS {m}_n, coalesce(avg(b_{m} - a_{m}), 0.0) AS {m}_diff, coalesce(stddev_samp(b_{m} - a_{m}), 0.0) AS {m}_sd" for m in ("recall", "top1", "abstained", "leaked", "failed"))


def _side(name: str, found: str) -> str:
    return f"""{name}_got AS (SELECT r.request_id AS case_id, count(*) AS n, count(*) FILTER (role = 'relevant') AS hits, bool_or(coalesce(role = 'relevant' AND rank = 1, false)) AS first, bool_or(coalesce(role = 'forbidden', false)) AS leak
  FROM {found} r LEFT JOIN cs c ON c.case_id = r.request_id AND c.fact_id = r.id WHERE rank <= {K} GROUP BY ALL),
{name}_out AS (SELECT case_id, relevant, guarded, CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant END AS {name}_recall, CASE WHEN relevant > 0 THEN CAST(coalesce(first, false) AS DOUBLE) END AS {name}_top1, CASE WHEN relevant = 0 THEN CAST(coalesce(n, 0) = 0 AS DOUBLE) END AS {name}_abstained,
  CAST(coalesce(leak, false) AS DOUBLE) AS {name}_leaked, 0.0::DOUBLE AS {name}_failed FROM ch LEFT JOIN {name}_got USING (case_id))"""


def _checks() -> str:
    rows = [("trusted-purpose", "evidence", "0", 1, ">="), *((f"minimum-{n}", "evidence", n, _P[n], ">=") for n in ("cases", "answerable", "abstention", "safety")), ("forbidden-leaks", "redline", "leaked_sum", _P["leaks"], "<="), ("failure-rate", "redline", "failed_sum / greatest(failed_n, 1)", _P["failure"], "<="),
            ("leak-upper95", "quality", _wilson("leaked", False), _P["leak_high"], "<="), ("failure-upper95", "quality", _wilson("failed", False), _P["failure_high"], "<="), *((f"{m}-lower95", "quality", _wilson(m, True), _P[f"{m}_low"], ">=") for m in ("recall", "top1", "abstained")),
            *((f"{m}-not-behind", "quality", f"{m}_diff", -_P["behind"], ">=") for m in ("recall", "top1", "abstained")), *((f"{m}-not-behind-lower95", "quality", f"{m}_diff - {rollout.Z} * {m}_sd / sqrt(greatest({m}_n, 1))", -_P["behind"], ">=") for m in ("recall", "top1", "abstained"))]
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{k}' AS kind, round(CAST({o} AS DOUBLE), 6) AS observed, CAST({r} AS DOUBLE) AS required, {o} {op} {r} AS passed FROM rep" for c, k, o, r, op in rows)


ROLLOUT_GATE = f"""WITH RECURSIVE old AS ({hybrid.RECALL_HYBRID}), new AS ({hierarchical.RECALL_HIERARCHICAL}), {hybrid.FACTS}, keys(q, key) AS (VALUES {_KEYS}),
cs AS (SELECT c_custkey AS case_id, f.id AS fact_id, CASE f.status WHEN 'active' THEN 'relevant' WHEN 'superseded' THEN 'forbidden' END AS role FROM customer LEFT JOIN keys ON c_custkey % {len(hybrid.QUESTIONS)} = q LEFT JOIN v_fact f ON f.owner = c_custkey AND f.key = keys.key WHERE c_custkey % {len(hybrid.QUESTIONS)} IN ({_ASKED})),
ch AS (SELECT case_id, count(*) FILTER (role = 'relevant') AS relevant, count(*) FILTER (role = 'forbidden') > 0 AS guarded FROM cs GROUP BY case_id), {_side("a", "old")}, {_side("b", "new")},
rep AS (SELECT count(*) AS cases, count(*) FILTER (a.relevant > 0) AS answerable, count(*) FILTER (a.relevant = 0) AS abstention, count(*) FILTER (a.guarded) AS safety, {_SUMS} FROM a_out a JOIN b_out USING (case_id)),
checks AS ({_checks()})
SELECT *, CASE WHEN bool_or(kind = 'redline' AND NOT passed) OVER () THEN 'blocked' WHEN bool_or(kind = 'evidence' AND NOT passed) OVER () THEN 'insufficient-data' WHEN bool_or(NOT passed) OVER () THEN 'blocked' ELSE 'eligible-for-review' END AS decision FROM checks"""

QUERIES = {"rollout_gate": rollout_gate}
ORACLES = {"rollout_gate": ROLLOUT_GATE}
