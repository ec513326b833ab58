"""Queries on retrieval: lexical, dense and sparse routes, fusion, budgets, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import evaluation, fusion, lexical, vectors
from factloom.operators.tables import BROADCAST, kept
from factloom.plans import views

#: Rows of a result, and of a route that is fused or scored again.
K, WINDOW = 5, 100


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.index(views.documents(spark, sf_dir), text.word_tokens)


def _bm25(spark: SparkSession, sf_dir: str, mode: str = "all", index: DataFrame | None = None) -> DataFrame:
    scored = lexical.bm25(views.benchmark_queries(spark, sf_dir), views.documents(spark, sf_dir), mode, text.word_tokens, index=index)
    return scored.select("query_id", "shard", F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents of every source for every benchmark phrase, by the rounded raw score."""
    top = lexical.top_per(_bm25(spark, sf_dir), ["query_id", "shard"], K, F.desc("score"), F.asc("id"))
    return top.select("query_id", "shard", "id", "rank", "score", F.round(scores.squashed(F.col("score")), 6).alias("squashed"))


def bm25_active_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical.top_per(_bm25(spark, sf_dir, "active"), ["query_id", "shard"], K, F.desc("score"), F.asc("id"))
    return top.select("query_id", "shard", "id", "rank", "score")


def _bm25_sql(where: str = "") -> str:
    return f"""v_query AS (SELECT item_id AS query_id, text, substring(text, 11, 80) AS passage FROM benchmark),
v_doc AS (SELECT source AS shard, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents {where}),
term AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM v_query),
tok AS (SELECT shard, doc_id, len(toks) AS length, unnest(toks) AS token FROM v_doc),
post AS (SELECT shard, doc_id, token, count(*) AS tf, any_value(length) AS length FROM tok GROUP BY ALL),
df AS (SELECT shard, token, count(*) AS df FROM post GROUP BY ALL),
st AS (SELECT shard, count(*) AS docs, avg(len(toks)) AS mean_length FROM v_doc GROUP BY ALL),
bm AS (
  SELECT query_id, shard, doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
  FROM term JOIN post USING (token) JOIN df USING (shard, token) JOIN st USING (shard) GROUP BY query_id, shard, doc_id
)"""


BM25_TOPK = f"""WITH {_bm25_sql()},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm)
SELECT query_id, shard, id, rank, score, round(1 - exp(-score), 6) AS squashed FROM r WHERE rank <= 5"""

BM25_ACTIVE = f"""WITH {_bm25_sql("WHERE doc_id % 2 = 0")},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm)
SELECT query_id, shard, id, rank, score FROM r WHERE rank <= 5"""


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = views.documents(spark, sf_dir), _index(spark, sf_dir)
    active = lexical.shard_statistics(docs, "active", index).select("shard", F.col("docs").alias("active_docs"), F.col("mean_length").alias("active_mean"))
    terms = index.groupBy("shard").agg(F.count_distinct("token").alias("terms"), F.sum("tf").alias("tokens"))
    return lexical.shard_statistics(docs, "all", index).join(active, "shard", "left").join(terms, "shard", "left").select(
        "shard", "docs", F.round("mean_length", 6).alias("mean_length"), F.coalesce("active_docs", F.lit(0)).alias("active_docs"), F.round("active_mean", 6).alias("active_mean"), "terms", "tokens"
    )


CORPUS_STATISTICS = """WITH d AS (SELECT source AS shard, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT shard, count(*) AS docs, round(avg(len(t)), 6) AS mean_length, count(*) FILTER (doc_id % 2 = 0) AS active_docs, round(avg(len(t)) FILTER (doc_id % 2 = 0), 6) AS active_mean FROM d GROUP BY shard),
x AS (SELECT shard, count(DISTINCT k) AS terms, count(*) AS tokens FROM (SELECT shard, unnest(t) AS k FROM d) GROUP BY shard)
SELECT * FROM s LEFT JOIN x USING (shard)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.read(spark, sf_dir, "embeddings").where(vectors.is_unit("embedding", 64)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), rows


def _dense(spark: SparkSession, sf_dir: str, least: float | None = None, k: int | None = None) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    found = vectors.dense_scores(queries, rows, least, k).where("query_id <> id")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_per(_dense(spark, sf_dir, k=K + 1), ["query_id"], K, F.desc("score"), F.asc("id")).select("query_id", "id", "rank", "score")


def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 0.45).where("score >= 0.45")


_DENSE = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND abs(sqrt(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) - 1) <= 0.03),
s AS (SELECT q.id AS query_id, v.id, round(list_inner_product(q.e, v.e), 6) AS score FROM v q JOIN v ON q.id % 50 = 0 AND q.id <> v.id)"""
DENSE_TOPK = f"""WITH {_DENSE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, id, rank, score FROM r WHERE rank <= 5"""
DENSE_THRESHOLD = f"WITH {_DENSE} SELECT query_id, id, score FROM s WHERE score >= 0.45"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of documents for every phrase: BM25 over all, and BM25 over active documents (those of even id, which
    stand in for a state). A third route, shared rare words, is missing."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return lexical.top_per(df, ["query_id"], WINDOW, F.desc("score"), F.asc("id")).select("query_id", "id", F.lit(name).alias("route"), "rank")

    index = _index(spark, sf_dir)
    every, active = _bm25(spark, sf_dir, index=index), _bm25(spark, sf_dir, "active", index)
    return ranked(every, "all").unionByName(ranked(active, "active"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(_routes(spark, sf_dir))
    fused = fused.select("query_id", "id", F.round("fused", 9).alias("fused"), F.round("relative", 6).alias("relative"), "routes")
    return lexical.top_per(fused, ["query_id"], 10, F.desc("fused"), F.asc("id"))


_ROUTES = f"""{_bm25_sql()}, {_bm25_sql("WHERE doc_id % 2 = 0").replace("v_query", "q2").replace("v_doc", "d2").replace("term", "term2").replace("tok AS", "tok2 AS").replace("FROM tok ", "FROM tok2 ").replace("post AS", "post2 AS").replace("FROM post ", "FROM post2 ").replace("JOIN post ", "JOIN post2 ").replace("df AS (", "df2 AS (").replace("JOIN df ", "JOIN df2 ").replace("st AS", "st2 AS").replace("JOIN st ", "JOIN st2 ").replace("bm AS", "bm2 AS")},
ranked AS (
  SELECT query_id, id, 'all' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm
  UNION ALL SELECT query_id, id, 'active', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM bm2
), fused AS (
  SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS f, count(*) AS routes FROM ranked WHERE rank <= 100 GROUP BY query_id, id
), rel AS (
  SELECT query_id, id, round(f, 9) AS fused, round(f / max(f) OVER (PARTITION BY query_id), 6) AS relative, routes FROM fused
)"""
RRF_FUSION = f"""WITH {_ROUTES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS INTEGER) AS rank FROM rel)
SELECT query_id, id, fused, relative, routes, rank FROM r WHERE rank <= 10"""


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first WINDOW documents of plain BM25 for each phrase."""
    return lexical.top_per(_bm25(spark, sf_dir), ["query_id"], WINDOW, F.desc("score"), F.asc("id"))


def _linear(spark: SparkSession, sf_dir: str, window: DataFrame) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents")
    features = docs.select(
        F.col("doc_id").alias("id"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("importance"), F.pow(F.lit(0.5), (F.col("doc_id") % 365) / 240.0).alias("recency"), scores.frequency(F.col("doc_id") % 21).alias("frequency")
    )
    top = window.select("query_id", "id", scores.squashed(F.col("score") / 10).alias("lexical"))
    value = fusion.weighted_linear(F.lit(0.0), F.col("lexical"), F.col("importance"), F.col("recency"), F.col("frequency"), F.lit(0.7))
    return top.join(features, "id").select("query_id", "id", F.round(value, 6).alias("score"))


def weighted_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_per(_linear(spark, sf_dir, _window(spark, sf_dir)), ["query_id"], 10, F.desc("score"), F.asc("id")).select("query_id", "id", "rank", "score")


_LINEAR = f"""{_bm25_sql()},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM bm),
lin AS (
  SELECT query_id, id, round(0.2 * (1 - exp(-score / 10)) + 0.14 * least(1.0, n_chars / 5000.0) + 0.08 * pow(0.5, (doc_id % 365) / 240.0) + 0.04 * least(1.0, ln(1 + doc_id % 21) / ln(21.0)) + 0.14 * 0.7, 6) AS score
  FROM top JOIN documents ON id = doc_id WHERE n <= 100
)"""
WEIGHTED_LINEAR = f"""WITH {_LINEAR}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM lin)
SELECT query_id, id, rank, score FROM r WHERE rank <= 10"""


def _relevant(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    """Documents that hold a query's passage whole. Candidates come from the longest word inside the passage, so that no
    query meets all texts; a passage without one, of two words or fewer, has no relevant documents."""
    queries, docs = views.benchmark_queries(spark, sf_dir), views.read(spark, sf_dir, "documents")
    inner = F.array_distinct(F.regexp_extract_all("passage", F.lit(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])"), 0))
    held = queries.withColumn("anchor", F.lower(F.try_element_at(F.array_sort(inner, lambda a, b: F.length(b) - F.length(a)), F.lit(1))))
    index = _index(spark, sf_dir) if index is None else index
    words = index.select("doc_id", F.col("token").alias("anchor"))
    candidates = held.join(words, "anchor").select("query_id", "passage", "doc_id")
    return candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("id"))


_RELEVANT = "relevant AS (SELECT query_id AS case_id, doc_id AS id FROM v_query q JOIN documents d ON contains(d.text, q.passage))"


def _metrics(spark: SparkSession, sf_dir: str, hits: DataFrame, index: DataFrame | None = None) -> DataFrame:
    cases = views.benchmark_queries(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.concat(F.lit("c"), F.col("query_id") % 3).alias("category"))
    return evaluation.rolled_up(evaluation.case_metrics(hits, _relevant(spark, sf_dir, index), cases), "category")


def _lexical_hits(spark: SparkSession, sf_dir: str, index: DataFrame | None = None) -> DataFrame:
    return lexical.top_per(_bm25(spark, sf_dir, index=index), ["query_id"], K, F.desc("score"), F.asc("id")).select(F.col("query_id").alias("case_id"), "id", "rank")


def _round_metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *(F.round(m, 6).alias(m) for m in evaluation.METRICS))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return _round_metrics(_metrics(spark, sf_dir, _lexical_hits(spark, sf_dir, index), index), "category")


def _metrics_sql(hits: str) -> str:
    return f"""cases AS (SELECT query_id AS case_id, 'c' || (query_id % 3) AS category FROM v_query),
hit AS (SELECT case_id, count(*) AS n_hits, min(rank) AS first_rank, sum(1 / log2(rank + 1.0)) AS dcg FROM {hits} JOIN relevant USING (case_id, id) GROUP BY case_id),
ret AS (SELECT case_id, count(*) AS n_returned FROM {hits} GROUP BY case_id),
rel_n AS (SELECT case_id, count(*) AS n_relevant FROM relevant GROUP BY case_id),
per AS (
  SELECT category, CASE WHEN n_relevant > 0 THEN coalesce(n_hits, 0) / n_relevant END AS recall, CASE WHEN n_relevant > 0 THEN CAST(coalesce(n_hits, 0) > 0 AS INT) END AS hit,
    CASE WHEN n_relevant > 0 THEN CAST(coalesce(first_rank, 0) = 1 AS INT) END AS top1, CASE WHEN n_relevant > 0 THEN coalesce(1.0 / first_rank, 0) END AS mrr,
    CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n_relevant, 5)), lambda i: 1 / log2(i + 1.0))) END AS ndcg,
    CASE WHEN coalesce(n_relevant, 0) = 0 THEN CAST(coalesce(n_returned, 0) = 0 AS INT) END AS abstained
  FROM cases LEFT JOIN hit USING (case_id) LEFT JOIN ret USING (case_id) LEFT JOIN rel_n USING (case_id)
), rolled AS (
  SELECT category, count(*) AS n, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(hit), 0), 6) AS hit, round(coalesce(avg(top1), 0), 6) AS top1, round(coalesce(avg(mrr), 0), 6) AS mrr,
    round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(avg(abstained), 0), 6) AS abstained
  FROM per GROUP BY ROLLUP (category)
)"""


RETRIEVAL_METRICS = f"""WITH {_bm25_sql()}, {_RELEVANT},
top AS (SELECT query_id AS case_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 5),
{_metrics_sql("top")} SELECT * FROM rolled"""


def strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies for each phrase: how far the five documents of plain BM25 and of the weighted score agree. Both read one
    stored window, so that documents are scored once."""
    window = kept(_window(spark, sf_dir), "window")
    linear = lexical.top_per(_linear(spark, sf_dir, window), ["query_id"], K, F.desc("score"), F.asc("id")).select(F.col("query_id").alias("case_id"), "id")
    both = evaluation.set_overlap(window.where(F.col("rank") <= K).select(F.col("query_id").alias("case_id"), "id"), linear)
    return both.select("case_id", "n_a", "n_b", "common", *(F.round(c, 6).alias(c) for c in ("jaccard", "recall", "precision")))


STRATEGY_COMPARE = f"""WITH {_LINEAR},
a AS (SELECT query_id AS case_id, id FROM top WHERE n <= 5),
b AS (SELECT query_id AS case_id, id FROM lin QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
u AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, CAST(a.id IS NOT NULL AS INT) AS x, CAST(b.id IS NOT NULL AS INT) AS y FROM a FULL JOIN b ON a.case_id = b.case_id AND a.id = b.id),
g AS (SELECT case_id, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b, CAST(sum(x * y) AS BIGINT) AS common FROM u GROUP BY case_id)
SELECT *, round(common / (n_a + n_b - common), 6) AS jaccard, round(CASE WHEN n_a > 0 THEN common / n_a ELSE 0 END, 6) AS recall, round(CASE WHEN n_b > 0 THEN common / n_b ELSE 0 END, 6) AS precision FROM g"""


def tier_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each phrase by tier quotas: hot, warm and cold documents by their id."""
    tier = F.when(F.col("id") % 10 < 2, "hot").when(F.col("id") % 10 < 6, "warm").otherwise("cold")
    return fusion.tier_quota(_bm25(spark, sf_dir).withColumn("tier", tier), {"hot": 3, "warm": 4, "cold": 2}, 8).select("query_id", "id", "tier", "rank", "score")


TIER_QUOTAS = f"""WITH {_bm25_sql()},
t AS (SELECT query_id, id, score, CASE WHEN id % 10 < 2 THEN 'hot' WHEN id % 10 < 6 THEN 'warm' ELSE 'cold' END AS tier FROM bm),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, id) AS n FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM o WHERE n <= CASE tier WHEN 'hot' THEN 3 WHEN 'warm' THEN 4 ELSE 2 END)
SELECT query_id, id, tier, rank, score FROM r WHERE rank <= 8"""


def best(spark: SparkSession, sf_dir: str, k: int, *of_query: str) -> DataFrame:
    """The k best documents of each phrase, with those columns of it; where phrases are few they go to the tables that they are
    joined to, of which no row is shuffled or sent to the driver, however few bytes the optimiser makes of their columns."""
    queries = views.benchmark_queries(spark, sf_dir)
    top = lexical.top_per(_bm25(spark, sf_dir), ["query_id"], k, F.desc("score"), F.asc("id"))
    top = top.join(queries.select("query_id", *of_query), "query_id") if of_query else top
    return F.broadcast(top) if queries.count() * k <= BROADCAST else top


def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each phrase in rank order while their characters stay within 12,000."""
    sized = best(spark, sf_dir, 20).join(views.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return fusion.within_budget(sized, "query_id", F.col("n_chars"), 12_000).select("query_id", "id", "rank", "n_chars", "spent")


EVIDENCE_BUDGET = f"""WITH {_bm25_sql()},
r AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 20),
s AS (SELECT query_id, id, rank, n_chars, CAST(sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS spent FROM r JOIN documents ON id = doc_id)
SELECT * FROM s WHERE spent <= 12000"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_active_mode, corpus_statistics, dense_topk, dense_threshold, rrf_fusion, weighted_linear, retrieval_metrics, strategy_compare, tier_quotas, evidence_budget)}
ORACLES = {
    "bm25_topk": BM25_TOPK, "bm25_active_mode": BM25_ACTIVE, "corpus_statistics": CORPUS_STATISTICS, "dense_topk": DENSE_TOPK, "dense_threshold": DENSE_THRESHOLD, "rrf_fusion": RRF_FUSION,
    "weighted_linear": WEIGHTED_LINEAR, "retrieval_metrics": RETRIEVAL_METRICS, "strategy_compare": STRATEGY_COMPARE, "tier_quotas": TIER_QUOTAS, "evidence_budget": EVIDENCE_BUDGET,
}
