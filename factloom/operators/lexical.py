"""BM25 over an inverted index held as tables: postings, document lengths and corpus statistics by shard.

Skewed tokens: only tokens that some query has are kept before anything is joined, so that the posting side shrinks to the
queries' vocabulary. Document frequencies go to the postings, which stay where they are. The index lies in buckets by document: a
task reads one, makes the pairs of its own documents alone, adds them up there, and neither a posting nor a pair is shuffled before
its score is whole. Where queries are so many that a bucket has too many pairs, postings are dealt anew, into more tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import lexical_tokens
from factloom.operators.tables import in_buckets, kept

K1, B = 1.2, 0.75
#: Documents that a task tokenises and counts, or reads from the index; pairs of a query and a document that it may have to hold,
#: terms of queries, or of shards, that may be broadcast, and postings that meet their frequency in one task where those are more.
DOCS, PAIRS, TERMS, ROWS = 2_000, 500_000, 200_000, 1_000_000
#: Buckets of a table, at most: Spark's own bound.
BUCKETS = 100_000


def _buckets(docs: DataFrame) -> int:
    """Tasks that make the postings of docs, and buckets that hold them."""
    return min(BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // DOCS)))


def postings(docs: DataFrame, tokens: Callable[[str], Column] = lexical_tokens) -> DataFrame:
    """docs (shard, doc_id, text, active) -> (shard, doc_id, active, token, tf, length)."""
    # dealt by document before words are counted, so that no word is shuffled and a task holds those of its documents alone
    held = docs.select("shard", "doc_id", "active", "text").repartition(_buckets(docs), "shard", "doc_id").select("shard", "doc_id", "active", tokens("text").alias("tokens"))
    # outer, as a plain explode makes the optimiser tokenise once more to leave out texts without tokens
    exploded = held.select("shard", "doc_id", "active", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("token")).where("token is not null")
    return exploded.groupBy("shard", "doc_id", "active", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def index(docs: DataFrame, tokens: Callable[[str], Column] = lexical_tokens) -> DataFrame:
    """The postings of docs, computed once and kept in the shared folder as a table in buckets by document, for several modes and
    statistics to read."""
    return in_buckets(postings(docs, tokens), "postings", _buckets(docs), ["shard", "doc_id"])


_stored = index


def shard_statistics(docs: DataFrame, mode: str, index: DataFrame) -> DataFrame:
    """(shard, docs, mean_length) over active documents, or over all in mode `all`. Texts are not read: lengths are the sums
    of the index."""
    counted, posted = (docs.where("active"), index.where("active")) if mode == "active" else (docs, index)
    lengths = posted.groupBy("shard").agg(F.sum("tf").alias("tokens"))
    joined = counted.groupBy("shard").agg(F.count("*").alias("docs")).join(lengths, "shard", "left")
    return joined.select("shard", "docs", (F.coalesce("tokens", F.lit(0)) / F.col("docs")).alias("mean_length"))


def _with_frequency(posted: DataFrame) -> DataFrame:
    """posted with df, the documents of its shard that have its token. Few frequencies are broadcast; of many, each meets the
    postings of its token in parts, in a number of tasks that grows with the postings."""
    df = kept(posted.groupBy("shard", "token").agg(F.count("*").alias("df")), "frequencies")
    n, most, rows = df.agg(F.count("*"), F.coalesce(F.max("df"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    if n <= TERMS:
        return posted.join(F.broadcast(df), ["shard", "token"])
    parts, keys = -(-most // ROWS), ["shard", "token", "_part"]
    tasks = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    dealt = posted.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(tasks, *keys)
    many = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, *keys)
    return dealt.join(many.hint("merge"), keys).drop("_part")


def bm25(queries: DataFrame, docs: DataFrame, mode: str = "all", tokens: Callable[[str], Column] = lexical_tokens, k1: float = K1, b: float = B, *, index: DataFrame | None = None) -> DataFrame:
    """queries (query_id, text) x docs (shard, doc_id, text, active) -> (query_id, shard, doc_id, score), in every shard.
    index: of docs, if there is one. Mode `active` counts and returns active documents only."""
    posted = _stored(docs, tokens) if index is None else index
    stats = shard_statistics(docs, mode, posted)
    posted = posted.where("active") if mode == "active" else posted
    terms = kept(queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("token")), "terms")
    asked, n_terms = queries.count(), terms.count()
    small = F.broadcast if n_terms <= TERMS else lambda df: df
    posted = posted.join(small(terms.select("token").distinct()), "token", "left_semi")
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    weighted = _with_frequency(posted).join(F.broadcast(stats), "shard").select("shard", "doc_id", "token", (idf * weight).alias("w"))
    # into as many tasks as the index has buckets nothing moves; more have a number of their own, which adaptive execution leaves
    # as it is: by bytes it would put the few columns of many documents together
    buckets, tasks = _buckets(docs), -(-docs.count() * asked // PAIRS)
    tasks = buckets if tasks <= buckets else max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    return weighted.repartition(tasks, "shard", "doc_id").join(small(terms), "token").groupBy("query_id", "shard", "doc_id").agg(F.sum("w").alias("score"))


def top_per(scored: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """scored with `rank`, cut to the k best of each group; the order must end in a unique key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
