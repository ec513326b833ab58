"""Exact top-k search by inner product: branch-and-bound over dimension blocks in vertical layout.

Queries and candidates are cut into groups of a fixed number of rows, and each pair of groups, a tile, is one unit of
work: the tile's candidates lie as one column for each dimension. The dimensions are taken block by block, those of
largest query mass first. After a block a candidate can still gain at most the product of the norms of what remains of
it and of the query; candidates that can't reach the query's k-th best score so far leave, and the survivors are
compacted. Scores are sums of integers, exact as floating-point numbers while components are below a bound; vectors with
larger ones are scored whole by integers of any length. A tile returns k rows for each query at most, and the
last step merges those by rank.

Defined results: a vector that is null, or has null or non-finite components, takes no part; vectors of other lengths
than the query's are no candidates for it; a query meets all rows but its own, told apart by row and not only by id, so
that a repeated id is a candidate like any other; a score beyond 64 bits ranks by its exact value and is given as the
nearest 64-bit number; ties go to the smaller id; with fewer than k candidates all are
returned; empty tables give empty results. Columns other than id and vector aren't read.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import shards, stored, table

#: Rows of a tile on either side, and dimensions of a block.
TILE_CANDIDATES, TILE_QUERIES, DIMENSIONS = 32_768, 4_096, 16
#: Queries and candidates that one step scores together, and candidates scored whole first, for a bound to start from.
QUERIES_AT_ONCE, STEP, SEED = 256, 4_096, 1_024
SCALE = 256.0


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only; false for null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)), F.lit(False))


def whole(x: float, scale: float) -> int:
    """floor(scale * x), exact for any finite x."""
    return math.floor(Fraction(scale) * Fraction(x))


def wide_key(score: int) -> str:
    """A text that sorts as the number does."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(chr(105 - ord(c)) for c in digits)


def best_by_integers(queries: list, own: np.ndarray, rows: np.ndarray, vectors: list, k: int, scale: float) -> Iterator[tuple[int, int, int]]:
    """(query, place, score): like best_of_block, by integers of any length, for vectors as they are given."""
    held = [[whole(x, scale) for x in v] for v in vectors]
    for i, q in enumerate(queries):
        mine = [whole(x, scale) for x in q]
        scores = ((sum(map(operator.mul, mine, v)), -p) for p, v in enumerate(held) if rows[p] != own[i])
        for score, place in heapq.nlargest(k, scores):
            yield i, -place, score


def best_of_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int, width: int = DIMENSIONS, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, places, scores) of the k best candidates of every query, best first, for some queries at a time.
    Candidates are given as columns[dimension, candidate], in ascending order of id; own, rows: the rows of either side."""
    d, n = columns.shape
    order = np.argsort(-(queries.astype("f8") ** 2).sum(0), kind="stable")  # most query mass first
    down = columns[order].astype("f8")  # products of quantised components and their sums stay below 2^53
    cuts = [*range(width, d, width), d]
    c_left = np.sqrt(np.stack([(down[at:] ** 2).sum(0) for at in cuts]))
    for some in np.array_split(np.arange(len(queries)), max(1, -(-len(queries) // QUERIES_AT_ONCE))):
        q, mine = queries[some][:, order].astype("f8"), own[some]
        q_left = np.sqrt(np.stack([(q[:, at:] ** 2).sum(1) for at in cuts]))
        best = np.full((len(some), k), -np.inf)  # scores, and the places of those candidates
        best_at = np.full((len(some), k), n, "i8")
        for a in [0, *range(SEED, n, step)]:
            b = min(n, SEED if a == 0 else a + step)
            least, at = best[:, -1], cuts[0]
            scores = q[:, :at] @ down[:at, a:b]
            pairs = None
            for block, end in enumerate(cuts):
                if block and pairs is None:
                    scores += q[:, at:end] @ down[at:end, a:b]
                elif block:
                    qi, ci, s = pairs
                    pairs = (qi, ci, s + np.einsum("ij,ji->i", q[qi, at:end], down[at:end, a + ci]))
                at = end
                # what remains can't exceed the product of the norms; a tie loses to those found, as places ascend by id
                if pairs is None:
                    alive = scores + q_left[block][:, None] * c_left[block][None, a:b] * (1 + 1e-9) + (1e-6 if end < d else 0) > least[:, None]
                    if end == d or alive.mean() < 0.1:
                        qi, ci = np.nonzero(alive)
                        pairs = (qi, ci, scores[qi, ci])
                else:
                    qi, ci, s = pairs
                    alive = s + q_left[block][qi] * c_left[block][a + ci] * (1 + 1e-9) + (1e-6 if end < d else 0) > least[qi]
                    pairs = (qi[alive], ci[alive], s[alive])
            qi, ci, s = pairs
            other = rows[a + ci] != mine[qi]
            qi, ci, s = qi[other], ci[other], s[other]
            if not len(qi):
                continue
            touched = np.unique(qi)
            owner = np.concatenate([qi, np.repeat(touched, k)])
            score, place = np.concatenate([s, best[touched].ravel()]), np.concatenate([a + ci, best_at[touched].ravel()])
            ranked = np.lexsort((place, -score, owner))
            first = np.searchsorted(owner[ranked], touched)
            top = ranked[first[:, None] + np.arange(k)]
            best[touched], best_at[touched] = score[top], place[top]
        qi, ki = np.nonzero(best_at < n)
        yield some[qi], best_at[qi, ki], best[qi, ki].astype("i8")


def top_k(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, id, score): for every row that is_query holds for, its k best other rows."""
    rows = vectors.where(usable(F.col(vector))).select(
        F.col(id).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row")
    )
    rows = stored(rows, "vectors")  # row numbers are fixed from here on
    n, queries = rows.agg(F.count("*"), F.count_if("q")).first()
    tiles, blocks = shards(n, TILE_CANDIDATES, 1), shards(queries, TILE_QUERIES, 1)
    tiles = max(tiles, min(shards(n, 2_048, 1), 24))  # a few tiles at least, so that small inputs use all cores

    def side(part: DataFrame, own: int, own_name: str, other: int, other_name: str) -> DataFrame:
        placed = part.withColumn(own_name, F.pmod(F.xxhash64("row"), F.lit(own)).cast("int"))
        return placed.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = side(rows.where("q"), blocks, "b", tiles, "t").select("b", "t", "id", "row", "v")
    # columns of its own, as a cogroup of one table with itself loses those that both sides share
    right = side(rows, tiles, "t", blocks, "b").select("b", "t", *(F.col(c).alias(c) for c in ("id", "row", "v")))

    schema = "query_id long, query_row long, id long, score long, wide string, row long"

    def tile(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []

        def add(q, places, scores, wide=None):
            out.append(pd.DataFrame({"query_id": qid[q], "query_row": own[q], "id": ids[places], "score": scores, "wide": wide, "row": at[places]}))

        def exactly(q: np.ndarray, some: np.ndarray) -> None:
            found = list(best_by_integers([qv[i] for i in q], own[q], at[some], [cv[i] for i in some], k, scale))
            if found:
                clipped = [max(-(2**63), min(2**63 - 1, s)) for _, _, s in found]
                add(q[[f[0] for f in found]], some[[f[1] for f in found]], clipped, [wide_key(s) for _, _, s in found])

        if not len(qs) or not len(cs):  # a side without rows comes without columns
            return pd.DataFrame(columns=["query_id", "query_row", "id", "score", "wide", "row"])
        lengths = cs["v"].map(len)
        for length, some in qs.groupby(qs["v"].map(len)):
            c = cs[lengths == length].sort_values(["id", "row"])
            if not len(c):
                continue
            ids, at, cv = c["id"].to_numpy(), c["row"].to_numpy(), np.stack(c["v"].to_numpy())
            own, qid, qv = some["row"].to_numpy(), some["id"].to_numpy(), np.stack(some["v"].to_numpy())
            bound = math.sqrt(2**53 / length) / scale - 1  # products of smaller components, and their sums, stay below 2^53
            small_c, small_q = (np.abs(v).max(1) < bound for v in (cv, qv))
            place, asked = np.flatnonzero(small_c), np.flatnonzero(small_q)
            if len(place) and len(asked):
                columns = np.ascontiguousarray(np.floor(scale * cv[place]).T)
                for q, places, scores in best_of_block(np.floor(scale * qv[asked]), own[asked], at[place], columns, k):
                    add(asked[q], place[places], scores)
            if not small_q.all():
                exactly(np.flatnonzero(~small_q), np.arange(len(cv)))
            if not small_c.all() and len(asked):
                exactly(asked, np.flatnonzero(~small_c))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "query_row", "id", "score", "wide", "row"])

    found = left.groupBy("b", "t").cogroup(right.groupBy("b", "t")).applyInPandas(tile, schema)
    # scores below 2^53 have no key of their own: it is made where a query has any
    plain = F.abs("score").cast("string")
    key = F.coalesce("wide", F.when(F.col("score") >= 0, F.concat(F.lit("1"), F.lpad(F.length(plain), 5, "0"), plain)).otherwise(F.concat(F.lit("0"), 99999 - F.length(plain), F.translate(plain, "0123456789", "9876543210"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc(key), "id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.r, c.r AS cr, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
