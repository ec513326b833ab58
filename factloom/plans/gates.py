"""Queries on literals, alias decisions, shared messages, source spans, write and safety metrics, retrieval rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import literals, text
from factloom.operators import gates, lexical, tables
from factloom.plans import lifecycle, retrieval, views


def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, amounts and words written out from every order, some with a day too many or a unit that contradicts the sign."""
    o = views.read(spark, sf_dir, "orders")
    day, dollars = F.col("o_orderdate"), F.floor("o_totalprice").cast("bigint")
    grouped = F.concat(F.lit("$ "), F.floor(dollars / 1000).cast("string"), F.lit(","), F.lpad((dollars % 1000).cast("string"), 3, "0"))
    later = F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), (F.dayofmonth(day) + 3).cast("string"), F.lit("日"))
    word = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", " 否 ").otherwise(F.col("o_orderstatus"))
    unit = F.when(F.col("o_orderpriority").startswith("1"), "eur").when(F.col("o_orderpriority").startswith("2"), "usd")
    rows = o.select(
        "o_orderkey", literals.calendar_date(F.date_format(day, "yyyy-MM-dd")).alias("day"), literals.calendar_date(later).alias("later"), literals.boolean(word).alias("flag"),
        literals.amount(grouped, unit, F.lit(True)).alias("signed"), literals.amount(F.concat(dollars.cast("string"), F.lit("万元")), unit, F.lit(False)).alias("scaled"),
        literals.amount(dollars.cast("string"), unit, F.lit(True)).alias("bare"),
    )
    parts = [F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in ("signed", "scaled", "bare") for part in ("value", "unit")]
    return rows.select("o_orderkey", "day", "later", "flag", *parts)


TYPED_LITERALS = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS v, date_trunc('month', o_orderdate) AS m,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'USD' END AS u FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN day(o_orderdate) + 3 <= day(m + INTERVAL 1 MONTH - INTERVAL 1 DAY) THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS later,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag,
  CASE WHEN u IS DISTINCT FROM 'EUR' THEN CAST(v AS DOUBLE) END AS signed_value, CASE WHEN u IS DISTINCT FROM 'EUR' THEN 'USD' END AS signed_unit,
  CAST(v AS DOUBLE) AS scaled_value, coalesce(u, '万元') AS scaled_unit, CASE WHEN u IS NOT NULL THEN CAST(v AS DOUBLE) END AS bare_value, u AS bare_unit FROM o"""


def canonical_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a decision on its part: returned lines split, others merge it into the part with its supplier's key."""
    li = views.read(spark, sf_dir, "lineitem")
    decisions = li.select(
        F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("canonical"), F.when(F.col("l_returnflag") == "R", "split").otherwise("merge").alias("action"),
        F.when(F.col("l_quantity") < 45, "accepted").otherwise("pending").alias("status"), F.col("l_shipdate").alias("recorded_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"),
    )
    return gates.canonical_members(decisions, views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")))


CANONICAL_ALIASES = """WITH d AS (SELECT l_partkey AS member, l_suppkey AS canonical, CASE WHEN l_returnflag = 'R' THEN 'split' ELSE 'merge' END AS action,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC, l_suppkey DESC, CASE WHEN l_returnflag = 'R' THEN 'split' ELSE 'merge' END DESC) AS n
  FROM lineitem WHERE l_quantity < 45 AND l_suppkey IN (SELECT p_partkey FROM part) AND l_partkey IN (SELECT p_partkey FROM part))
SELECT member, canonical FROM d WHERE n = 1 AND action = 'merge'"""


def neighbour_facts(spark: SparkSession, sf_dir: str, seeds: int = 12, most: int = 60) -> DataFrame:
    """For each owner, facts that share a message with one of the owner's 12 most important facts."""
    top = lexical.top_per(views.facts(spark, sf_dir).select(F.col("owner").alias("query_id"), "fact_id", "importance"), ["query_id"], seeds, F.desc("importance"), F.asc("fact_id"))
    return gates.sharing_messages(top.select("query_id", "fact_id"), views.links(spark, sf_dir).where("active"), most, seeds)


NEIGHBOUR_FACTS = f"""WITH {views.FACTS}, {views.LINKS},
s AS (SELECT owner AS query_id, fact_id FROM v_fact QUALIFY row_number() OVER (PARTITION BY owner ORDER BY importance DESC, fact_id) <= 12),
n AS (SELECT DISTINCT s.query_id, b.fact_id FROM s JOIN v_link a ON a.fact_id = s.fact_id AND a.active JOIN v_link b ON b.episode_id = a.episode_id AND b.active
  WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.query_id = s.query_id AND t.fact_id = b.fact_id))
SELECT query_id, fact_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 60"""


def exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn quotes the turn before it, from its 4th character, at the length of the turn itself; the quote's hash is that
    of the quoted text without blanks around it, and only texts without personal data may be read."""
    turns = views.episodes(spark, sf_dir).withColumn("p", text.privacy("content")).select("*", F.col("p.share").alias("share"), F.col("p.sensitivity").alias("sensitivity"))
    before = turns.select((F.col("episode_id") + 1).alias("ref_id"), F.col("content").alias("quoted"))
    start, end = F.lit(3), F.length("content")
    refs = turns.join(before, turns["episode_id"] == before["ref_id"], "left").select(
        F.col("episode_id").alias("ref_id"), (F.col("episode_id") - 1).alias("quoted_id"), F.sha2(F.trim(F.coalesce("quoted", F.lit(""))), 256).alias("content_hash"),
        F.coalesce(literals.utf16_offset("quoted", start), start).alias("start"), F.when(end <= F.length("quoted"), literals.utf16_offset("quoted", end)).otherwise(F.coalesce(end, F.lit(0)) + F.lit(100000)).alias("end"),
    ).withColumnRenamed("quoted_id", "episode_id")
    return gates.exact_spans(refs, turns, ["allow-remote"], ["normal"])


EXACT_SPANS = f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, coalesce(text, '') AS c, regexp_matches(coalesce(text, ''), '{lifecycle._PERSONAL}') AS personal FROM conversations),
r AS (SELECT a.id AS ref_id, a.id - 1 AS episode_id, b.c, CASE WHEN coalesce(b.c, '') = '' THEN 'missing' WHEN trim(b.c, ' ') <> b.c THEN 'changed' WHEN b.personal THEN 'withheld'
    WHEN a.text IS NULL OR length(a.text) > length(b.c) OR length(a.text) <= 3 THEN 'span' END AS reason, length(a.c) AS n
  FROM t a LEFT JOIN t b ON b.id = a.id - 1)
SELECT ref_id, episode_id, CASE WHEN reason IS NULL THEN substring(c, 4, n - 3) END AS span, reason FROM r"""


def write_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as expected and as predicted writes, keyed by return flag, by two rules; metrics for each priority."""
    li = views.read(spark, sf_dir, "lineitem")
    common = [F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("key"), "l_linenumber", "l_partkey"]

    def outcome(active):
        return F.when(active, "active").otherwise("rejected").alias("outcome")

    expected = li.where("l_quantity <= 40").select(*common, outcome(F.col("l_linestatus") == "O"), F.when(F.col("l_discount") >= 0.05, "insert").alias("action"))
    actual = li.where("l_tax <= 0.06").select(*common, outcome(F.year("l_shipdate") >= 1996), F.when(F.col("l_quantity") > 10, "insert").otherwise("reinforce").alias("action"))
    matched = gates.matched_writes(expected, actual, "l_linenumber", "l_partkey")
    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"))
    out = gates.write_metrics(matched.join(orders, "case_id"), "category")
    return out.select("category", "hits", "false_alarms", "misses", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "outcome_accuracy", "action_accuracy", "unsupported_rate")))


WRITE_METRICS = """WITH e AS (SELECT l_orderkey AS k, l_returnflag AS f, CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'rejected' END AS o, CASE WHEN l_discount >= 0.05 THEN 'insert' END AS a, l_linenumber, l_partkey FROM lineitem WHERE l_quantity <= 40),
g AS (SELECT l_orderkey AS k, l_returnflag AS f, CASE WHEN year(l_shipdate) >= 1996 THEN 'active' ELSE 'rejected' END AS o, CASE WHEN l_quantity > 10 THEN 'insert' ELSE 'reinforce' END AS a, l_linenumber, l_partkey FROM lineitem WHERE l_tax <= 0.06),
en AS (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY l_linenumber, l_partkey, o, a NULLS FIRST) AS n FROM e), gn AS (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY l_linenumber, l_partkey, o, a NULLS FIRST) AS n FROM g),
m AS (SELECT coalesce(en.k, gn.k) AS k, en.o AS w, gn.o AS g, en.a AS wa, gn.a AS ga FROM en FULL JOIN gn ON en.k = gn.k AND en.f = gn.f AND en.n = gn.n),
c AS (SELECT o_orderpriority AS category, count(*) FILTER (w IS NOT NULL AND g IS NOT NULL) AS hits, count(*) FILTER (w IS NULL) AS false_alarms, count(*) FILTER (g IS NULL) AS misses, count(*) FILTER (w = g) AS ro,
  count(*) FILTER (g IS NOT NULL AND wa IS NOT NULL) AS an, count(*) FILTER (wa = ga) AS ra, count(*) FILTER (g = 'active') AS ac, count(*) FILTER (g = 'active' AND w IS DISTINCT FROM 'active') AS un
  FROM m JOIN orders ON o_orderkey = k GROUP BY 1)
SELECT category, hits, false_alarms, misses, round(coalesce(hits / nullif(hits + false_alarms, 0), 1), 6) AS precision, round(coalesce(hits / nullif(hits + misses, 0), 1), 6) AS recall,
  round(coalesce(ro / nullif(hits, 0), 1), 6) AS outcome_accuracy, round(coalesce(ra / nullif(an, 0), 1), 6) AS action_accuracy, round(coalesce(un / nullif(ac, 0), 0), 6) AS unsupported_rate FROM c"""


def safety_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark queries whose candidates hold personal data (privacy) or fail the safety gate (safety), and those that get such
    a document among their five best."""
    index = retrieval._index(spark, sf_dir)
    docs = views.read(spark, sf_dir, "documents")
    tags = F.array_compact(F.array(F.when(text.privacy("text")["sensitivity"] == "private", "privacy"), F.when(~text.is_safe("text"), "safety")))
    tagged = docs.select(F.col("doc_id").alias("id"), tags.alias("tags")).where(F.size("tags") > 0)
    top = tables.kept(lexical.top_per(retrieval._bm25(spark, sf_dir, index=index), ["query_id"], 5, F.desc("score"), F.asc("id")), "top")
    # every document that shares a word is a candidate: whether one has a tag is asked of words, not of pairs; those shown follow
    words = index.select(F.col("doc_id").alias("id"), "token").join(tagged, "id").select("token", "id", F.explode("tags").alias("tag")).groupBy("token", "tag").agg(F.min("id").alias("id"))
    terms = views.benchmark_queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(text.word_tokens("text"))).alias("token"))
    met = terms.join(words, "token").groupBy("query_id", "tag").agg(F.min("id").alias("id")).select("query_id", "id", F.array("tag").alias("tags"))
    out = gates.leaks_by_tag(met.unionByName(top.select("query_id", "id").join(tagged, "id").select("query_id", "id", "tags")), top)
    return out.select("tag", "cases", "leaks", F.round("rate", 6).alias("rate"), F.round("bounds.low", 6).alias("low"), F.round("bounds.high", 6).alias("high"))


SAFETY_LEAKS = f"""WITH {retrieval._bm25_sql()},
t AS (SELECT doc_id AS id, 'privacy' AS tag FROM ({lifecycle.PRIVACY_CLASSIFY}) WHERE sensitivity = 'private' UNION ALL SELECT doc_id, 'safety' FROM ({lifecycle.SAFETY_GATE}) WHERE NOT is_safe),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5 AS shown FROM bm),
q AS (SELECT query_id, tag, bool_or(shown) AS leaked FROM r JOIN t USING (id) GROUP BY ALL),
c AS (SELECT tag, count(*) AS cases, count(*) FILTER (leaked) AS leaks FROM q GROUP BY tag),
p AS (SELECT *, leaks / cases AS r, CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE) AS z2 FROM c),
w AS (SELECT *, (r + z2 / (2 * cases)) / (1 + z2 / cases) AS m, 1.96 * sqrt(r * (1 - r) / cases + z2 / (4 * cases * cases)) / (1 + z2 / cases) AS s FROM p)
SELECT tag, cases, leaks, round(r, 6) AS rate, round(greatest(0, m - s), 6) AS low, round(least(1, m + s), 6) AS high FROM w"""


def retrieval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark query as retrieval events; a document's fact is the order of its number."""
    hits = retrieval.best(spark, sf_dir, 10, "text")
    mapping = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("fact_id"))
    rows = gates.retrieval_rows(hits, mapping, "text")
    return rows.select("query_id", "query_hash", F.array_join(F.col("fact_ids").cast("array<string>"), ",").alias("fact_ids"))


RETRIEVAL_ROWS = f"""WITH {retrieval._bm25_sql()},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM bm QUALIFY n <= 10)
SELECT query_id, sha256(any_value(text)) AS query_hash, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS fact_ids
FROM r JOIN v_query USING (query_id) WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY query_id"""


QUERIES = {f.__name__: f for f in (typed_literals, canonical_aliases, neighbour_facts, exact_spans, write_metrics, safety_leaks, retrieval_rows)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
