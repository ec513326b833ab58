"""Queries on graphs, audits, calibration and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.operators import audits, calibration, evaluation, graph, temporal
from factloom.plans import views

#: Seeds of the traversals, the parts of highest price, and their depth.
EVERY, HOPS = 50, 2


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.opposing(views.claims(spark, sf_dir), ["predicate", "subject"]).select("predicate", "subject", "a", "b", F.col("from").alias("since"), F.col("to").alias("until"))


CONFLICT_PAIRS = f"""WITH {views.CLAIMS}
SELECT DISTINCT x.predicate, x.subject, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, greatest(x.valid_from, y.valid_from) AS since, least(x.valid_to, y.valid_to) AS until
FROM v_claim x JOIN v_claim y ON x.predicate = y.predicate AND x.subject = y.subject AND x.polarity = 'positive' AND y.polarity = 'negative' AND x.valid_from < y.valid_to AND y.valid_from < x.valid_to"""


def neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of every part, by direction."""
    e = views.edges(spark, sf_dir)
    parts = [graph.neighbours(e, d).groupBy("node").agg(F.count_distinct("other").alias("n"), F.count("*").alias("edges")).select("node", F.lit(d).alias("direction"), "n", "edges") for d in ("out", "in", "both")]
    return parts[0].union(parts[1]).union(parts[2])


NEIGHBOR_COUNTS = f"""WITH {views.edges_sql()},
n AS (SELECT src AS node, 'out' AS direction, dst AS other, kind FROM v_edge UNION ALL SELECT dst, 'in', src, kind FROM v_edge
  UNION ALL SELECT * FROM (SELECT src, 'both', dst, kind FROM v_edge UNION SELECT dst, 'both', src, kind FROM v_edge))
SELECT node, direction, count(DISTINCT other) AS n, count(*) AS edges FROM n GROUP BY ALL"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of a traversal: every part whose key is divisible by EVERY."""
    return views.read(spark, sf_dir, "part").where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("node"))


_SEEDS = f"seed AS (SELECT p_partkey AS node FROM part WHERE p_partkey % {EVERY} = 0)"


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = graph.neighbours(views.edges(spark, sf_dir), "out").select("node", "other").distinct()
    roots = _seeds(spark, sf_dir).select(F.col("node").alias("root"), "node")
    return graph.shortest_paths(steps, roots, HOPS).select("root", "node", "depth", "parent")


def _level(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT root, node FROM l{i}" for i in range(k))
    return f"""l{k} AS (SELECT p.root, s.other AS node, {k} AS depth, min(s.node) AS parent FROM l{k - 1} p JOIN st s ON s.node = p.node
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.root = p.root AND x.node = s.other) GROUP BY p.root, s.other)"""


SHORTEST_PATHS = f"""WITH {views.edges_sql()}, {_SEEDS},
st AS (SELECT DISTINCT src AS node, dst AS other FROM v_edge),
l0 AS (SELECT node AS root, node, 0 AS depth, CAST(NULL AS BIGINT) AS parent FROM seed),
{", ".join(_level(k) for k in range(1, HOPS + 1))}
{" UNION ALL ".join(f"SELECT root, node, depth, parent FROM l{k}" for k in range(HOPS + 1))}"""


def purge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the seeds, where a part depends on each smaller one right before it in an order of kind A."""
    e = views.edges(spark, sf_dir).where("kind = 'A' and src < dst").select("src", "dst")
    return graph.purge_closure(e, _seeds(spark, sf_dir)).select("node").distinct()


PURGE_CLOSURE = f"""WITH RECURSIVE {views.edges_sql()}, {_SEEDS}, e AS (SELECT DISTINCT src, dst FROM v_edge WHERE kind = 'A' AND src < dst),
c(node) AS (SELECT node FROM seed UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT node FROM c"""


def components_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users connected by what they reported on the same hour, and the split that a salted hash deals each component."""
    e = views.read(spark, sf_dir, "events").where("event_type = 'signup'")
    hour = e.select(F.col("user_id").alias("u"), F.concat_ws(":", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string"), F.get_json_object("props", "$.k")).alias("h")).distinct()
    first = hour.groupBy("h").agg(F.min("u").alias("m"))
    links = hour.join(first, "h").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
    parts = graph.connected(links)
    share = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("salt:"), F.col("component")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    return parts.select(F.col("node").alias("user_id"), "component", F.when(share < 300, "validation").otherwise("calibration").alias("split"))


COMPONENTS_SPLIT = """WITH RECURSIVE h AS (SELECT DISTINCT user_id AS u, date_trunc('hour', ts) || ':' || (props->>'k') AS h FROM events WHERE event_type = 'signup'),
l AS (SELECT DISTINCT x.u AS a, y.u AS b FROM h x JOIN h y USING (h)),
c(node, r) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(r) AS component FROM c GROUP BY node)
SELECT node AS user_id, component, CASE WHEN CAST(('0x' || substring(sha256('salt:' || component), 1, 8)) AS BIGINT) % 1000 < 300 THEN 'validation' ELSE 'calibration' END AS split FROM m"""


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes (objects) that are given for a subject, and whether there are alternatives."""
    g = views.claims(spark, sf_dir).where("polarity = 'positive'").groupBy("subject").agg(
        F.count_distinct("predicate", "object").alias("causes"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"), F.count("*").alias("claims")
    )
    return g.withColumn("has_alternatives", F.col("causes") > 1)


ALTERNATIVES = f"""WITH {views.CLAIMS} SELECT subject, count(DISTINCT (predicate, object)) AS causes, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, count(*) AS claims,
  count(DISTINCT (predicate, object)) > 1 AS has_alternatives FROM v_claim WHERE polarity = 'positive' GROUP BY subject"""


def audit_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against a mirror with planted faults: some rows gone, some extra, some changed."""
    facts = views.facts(spark, sf_dir).select("fact_id", "owner", "value", "status", F.round("importance", 6).alias("importance"))
    mirror = facts.where("fact_id % 97 <> 0").select(
        F.when(F.col("fact_id") % 101 == 0, -F.col("fact_id")).otherwise(F.col("fact_id")).alias("fact_id"), "owner",
        F.when(F.col("fact_id") % 89 == 0, "X").otherwise(F.col("value")).alias("value"), F.when(F.col("fact_id") % 83 == 0, "active").otherwise(F.col("status")).alias("status"), "importance",
    )
    compared = {"content": F.col("s_value") != F.col("m_value"), "status": F.col("s_status") != F.col("m_status"), "unexpected-active": (F.col("m_status") == "active") & (F.col("s_status") != "active"), "scope": F.col("s_owner") != F.col("m_owner")}
    return audits.mirror_differences(facts, mirror, "fact_id", compared).withColumnRenamed("id", "fact_id")


AUDIT_MIRROR = f"""WITH {views.FACTS},
s AS (SELECT fact_id, owner, value, status FROM v_fact),
m AS (SELECT CASE WHEN fact_id % 101 = 0 THEN -fact_id ELSE fact_id END AS fact_id, owner, CASE WHEN fact_id % 89 = 0 THEN 'X' ELSE value END AS value, CASE WHEN fact_id % 83 = 0 THEN 'active' ELSE status END AS status FROM s WHERE fact_id % 97 <> 0),
b AS (SELECT coalesce(s.fact_id, m.fact_id) AS fact_id, s.fact_id IS NOT NULL AS ins, m.fact_id IS NOT NULL AS inm, s.value AS sv, m.value AS mv, s.status AS ss, m.status AS ms, s.owner AS so, m.owner AS mo FROM s FULL JOIN m USING (fact_id))
SELECT 'missing' AS issue, fact_id FROM b WHERE NOT inm UNION ALL SELECT 'unexpected', fact_id FROM b WHERE NOT ins
UNION ALL SELECT 'content', fact_id FROM b WHERE sv <> mv UNION ALL SELECT 'status', fact_id FROM b WHERE ss <> ms UNION ALL SELECT 'unexpected-active', fact_id FROM b WHERE ms = 'active' AND ss <> 'active'
UNION ALL SELECT 'scope', fact_id FROM b WHERE so <> mo"""


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each broken rule: chronology, score range, active facts without active evidence, unknown references, repeated keys."""
    facts, links = views.facts(spark, sf_dir), views.links(spark, sf_dir)
    rules = {"chronology": F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False)), "score-range": ~F.col("importance").between(0, 0.95), "self-supersede": F.coalesce(F.col("supersedes") == F.col("fact_id"), F.lit(False))}
    own = audits.violations(facts, "fact_id", rules)
    live = links.where("active").select("fact_id").distinct()
    bare = facts.where("status = 'active'").join(live, "fact_id", "left_anti").select(F.lit("active-without-evidence").alias("rule"), F.col("fact_id").alias("id"))
    lost = audits.dangling(links, "fact_id", facts, "fact_id", "unknown-fact")
    li = views.read(spark, sf_dir, "lineitem")
    twice = audits.repeated(li, ["l_orderkey", "l_linenumber"], "repeated-key").select("rule", F.split("id", ":")[0].cast("bigint").alias("id"))
    return own.unionByName(bare).unionByName(lost).unionByName(twice).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


INTEGRITY_VIOLATIONS = f"""WITH {views.FACTS}, {views.LINKS},
v AS (
  SELECT 'chronology' AS rule, fact_id AS id FROM v_fact WHERE valid_to <= valid_from UNION ALL SELECT 'score-range', fact_id FROM v_fact WHERE NOT importance BETWEEN 0 AND 0.95
  UNION ALL SELECT 'self-supersede', fact_id FROM v_fact WHERE supersedes = fact_id
  UNION ALL SELECT 'active-without-evidence', fact_id FROM v_fact f WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM v_link l WHERE l.fact_id = f.fact_id AND l.active)
  UNION ALL SELECT DISTINCT 'unknown-fact', fact_id FROM v_link l WHERE NOT EXISTS (SELECT 1 FROM v_fact f WHERE f.fact_id = l.fact_id)
  UNION ALL SELECT 'repeated-key', l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
) SELECT rule, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM v GROUP BY rule"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir)


def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = calibration.fitted_thresholds(_samples(spark, sf_dir), ["cohort"])
    return fitted.select("cohort", "threshold", F.round("cost", 6).alias("cost"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "positives", "negatives")


THRESHOLD_FIT = f"""WITH {views.SAMPLES},
c AS (SELECT cohort, score, count(*) FILTER (relevant) AS pos, count(*) FILTER (NOT relevant) AS neg FROM v_sample GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY cohort) AS p, sum(neg) OVER (PARTITION BY cohort) AS n FROM c WINDOW w AS (PARTITION BY cohort ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, 2.0 * fp + 1.0 * (p - tp) AS cost, (CASE WHEN p > 0 THEN tp / p ELSE 0 END + CASE WHEN n > 0 THEN (n - fp) / n ELSE 0 END) / 2 AS ba FROM r)
SELECT cohort, score AS threshold, CAST(round(cost, 6) AS DOUBLE) AS cost, round(ba, 6) AS balanced_accuracy, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM k
QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY cost, ba DESC, score DESC) = 1"""


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("accepted", F.col("score") >= 0.7)
    out = calibration.confusion(rows, ["cohort"])
    low = scores.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    rates = ("precision", "recall", "specificity", "fpr", "accuracy", "balanced_accuracy", "coverage")
    return out.select("cohort", "tp", "fp", "fn", "tn", "n", *(F.round(r, 6).alias(r) for r in rates), F.round(low["low"], 6).alias("precision_low"), F.round(low["high"], 6).alias("precision_high"))


CONFUSION_METRICS = f"""WITH {views.SAMPLES},
c AS (SELECT cohort, count(*) FILTER (score >= 0.7 AND relevant) AS tp, count(*) FILTER (score >= 0.7 AND NOT relevant) AS fp, count(*) FILTER (score < 0.7 AND relevant) AS fn, count(*) FILTER (score < 0.7 AND NOT relevant) AS tn, count(*) AS n FROM v_sample GROUP BY cohort),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp, tp + fp AS m FROM c)
SELECT cohort, tp, fp, fn, tn, n, round(pr, 6) AS precision, round(re, 6) AS recall, round(sp, 6) AS specificity, round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 6) AS fpr, round((tp + tn) / n, 6) AS accuracy,
  round((re + sp) / 2, 6) AS balanced_accuracy, round(m / n, 6) AS coverage,
  round(CASE WHEN m > 0 THEN greatest(0, (pr + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) - 1.96 * sqrt(pr * (1 - pr) / m + 1.96 * 1.96 / (4.0 * m * m)) / (1 + 1.96 * 1.96 / m)) ELSE 0 END, 6) AS precision_low,
  round(CASE WHEN m > 0 THEN least(1, (pr + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) + 1.96 * sqrt(pr * (1 - pr) / m + 1.96 * 1.96 / (4.0 * m * m)) / (1 + 1.96 * 1.96 / m)) ELSE 1 END, 6) AS precision_high FROM r"""


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.calibration_bins(_samples(spark, sf_dir), ["cohort"])
    return rows.select("cohort", "bin", "n", *(F.round(c, 6).alias(c) for c in ("predicted", "observed", "gap")))


CALIBRATION_BINS = f"""WITH {views.SAMPLES}
SELECT cohort, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(CAST(relevant AS INT)), 6) AS observed, round(abs(avg(score) - avg(CAST(relevant AS INT))), 6) AS gap FROM v_sample GROUP BY ALL"""


def calibration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.calibration_errors(_samples(spark, sf_dir), ["cohort"])
    return rows.select("cohort", *(F.round(c, 6).alias(c) for c in ("ece", "max_error", "brier", "log_loss")))


CALIBRATION_ERRORS = f"""WITH {views.SAMPLES},
b AS (SELECT cohort, least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(score) - avg(CAST(relevant AS INT))) AS gap FROM v_sample GROUP BY ALL),
e AS (SELECT cohort, sum(gap * n) / sum(n) AS ece, max(gap) AS max_error FROM b GROUP BY cohort),
l AS (SELECT cohort, avg(pow(score - CAST(relevant AS INT), 2)) AS brier, avg(-(CASE WHEN relevant THEN ln(least(greatest(score, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(score, 1e-6), 1 - 1e-6)) END)) AS log_loss FROM v_sample GROUP BY cohort)
SELECT cohort, round(ece, 6) AS ece, round(max_error, 6) AS max_error, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM e JOIN l USING (cohort)"""


def telemetry_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each day and, with a null day, of all: counts by outcome, mean and nearest-rank percentiles of latency."""
    rows = views.feedback(spark, sf_dir).withColumn("day", F.date_format("seen_at", "yyyy-MM-dd"))
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    p = lambda q, name: F.round(F.expr(f"percentile_disc({q}) within group (order by latency)"), 6).alias(name)
    return rows.rollup("day").agg(F.count("*").alias("n"), *(of(o) for o in ("adopted", "corrected", "denied", "injected", "retrieved")), F.round(F.avg("latency"), 4).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.round(F.max("latency"), 6).alias("most"))


TELEMETRY_DAILY = f"""WITH {views.FEEDBACK}, d AS (SELECT *, strftime(seen_at, '%Y-%m-%d') AS day FROM v_feedback)
SELECT day, count(*) AS n, count(*) FILTER (outcome = 'adopted') AS adopted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'denied') AS denied, count(*) FILTER (outcome = 'injected') AS injected,
  count(*) FILTER (outcome = 'retrieved') AS retrieved, round(avg(latency), 4) AS mean, round(quantile_disc(latency, 0.5), 6) AS p50, round(quantile_disc(latency, 0.95), 6) AS p95, round(quantile_disc(latency, 0.99), 6) AS p99, round(max(latency), 6) AS most
FROM d GROUP BY ROLLUP (day)"""


def recovery_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads directly after a failed one of the same user: how often each outcome recovers."""
    w = Window.partitionBy("owner").orderBy("seen_at", "event_id")
    rows = views.feedback(spark, sf_dir).withColumn("before", F.lag("outcome").over(w))
    g = rows.where("before = 'denied'").groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("owner").alias("owners"))
    return g.withColumn("recovered", F.col("outcome") != "denied")


RECOVERY_LAG = f"""WITH {views.FEEDBACK}, l AS (SELECT *, lag(outcome) OVER (PARTITION BY owner ORDER BY seen_at, event_id) AS before FROM v_feedback)
SELECT outcome, count(*) AS n, count(DISTINCT owner) AS owners, outcome <> 'denied' AS recovered FROM l WHERE before = 'denied' GROUP BY outcome"""


def extraction_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of shipped lines as gold, those of lines with a small discount as predictions, by predicate and overall."""
    li = views.read(spark, sf_dir, "lineitem")
    triples = [F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object")]
    out = evaluation.extraction_prf(li.where("l_linestatus = 'F'").select(*triples), li.where("l_discount <= 0.05").select(*triples), "predicate")
    return out.select("predicate", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


EXTRACTION_PRF = """WITH g AS (SELECT DISTINCT l_returnflag AS predicate, l_partkey AS s, l_suppkey AS o FROM lineitem WHERE l_linestatus = 'F'),
p AS (SELECT DISTINCT l_returnflag AS predicate, l_partkey AS s, l_suppkey AS o FROM lineitem WHERE l_discount <= 0.05),
u AS (SELECT coalesce(g.predicate, p.predicate) AS predicate, g.s IS NOT NULL AS ing, p.s IS NOT NULL AS inp FROM g FULL JOIN p ON g.predicate = p.predicate AND g.s = p.s AND g.o = p.o),
c AS (SELECT predicate, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing AND inp) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM u GROUP BY ROLLUP (predicate))
SELECT predicate, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""

QUERIES = {
    f.__name__: f
    for f in (
        conflict_pairs, neighbor_counts, shortest_paths, purge_closure, components_split, alternatives, audit_mirror, integrity_violations, threshold_fit, confusion_metrics, calibration_bins, calibration_errors,
        telemetry_daily, recovery_lag, extraction_prf,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
