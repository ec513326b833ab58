r"""Hard negatives: for each anchor and each of its best rows of the same label, the best rows of other labels whose scores
lie in a window below that positive's, by a multiway hyperplane tree with distance ranges.

Inner products become distances: a row gets one more component that lifts its norm to that of the longest row, an anchor
gets zero there, and then a score of s means the squared distance |a|^2 + M^2 - 2 s. A node of the tree has up to FANOUT
split points, far apart, each with the subtree of the rows that it is nearest to; for every split point and every sibling
subtree it stores the least and the largest distance between them. A window of scores is an annulus around the anchor. A
subtree is left out if, for some split point, the stored range doesn't meet the range that the annulus leaves possible by
the triangle inequality. Leaves that remain are compared exactly.

Split points come from a bounded sample (documented below); ranges and leaves come from all rows. Positives take two
rounds: the leaf that the anchor falls into bounds the ball, then all leaves that the ball meets. Negatives take one:
leaves that meet some window of the anchor. A leaf's rows are dealt into tiles of bounded size, anchors into blocks, and a
tile returns a bounded number of rows for each anchor.

Of rows with one vector and one label at most `positives` + 1 can be results, those of the smallest ids, as all have one
score with any anchor: Spark drops the rest before it shuffles. They still are anchors.

Defined results: rows with a null label, a null or empty vector, or null or non-finite components take no part; vectors of
another length than the anchor's are no candidates for it; rows are told apart by row, not only by id, so that a repeated
id is a row like any other, and a null id sorts first; scores are exact whatever the size of components, and given as the
nearest 64-bit number; with fewer candidates all are returned; an empty table gives an empty result. Columns other than
id, vector and label aren't read. Rows whose components are too large for exact floating-point sums, or whose length isn't
the commonest one, are kept in one more leaf that all anchors visit, and such anchors visit all leaves.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, shards, table
from factloom.llm.topk_search import usable, whole, wide_key

#: Split points of a node, levels at most (4,096 leaves), and rows of a leaf that the number of levels aims at.
FANOUT, LEVELS, LEAF = 16, 3, 4_096
#: The sample for split points: vectors, and components of all its vectors together.
SAMPLE, SAMPLE_VALUES = 16_384, 4_000_000
#: Rows of a tile, anchors of a block, and scores that one step holds.
TILE, BLOCK, STEP = 32_768, 4_096, 4_000_000
SCALE = 256.0
#: The leaf of rows that the tree can't hold. Distances are compared with this slack.
ODD, SLACK = -1, 1e-6


@dataclass
class Tree:
    """Nodes in order of levels: the children of node v are 1 + FANOUT * v + j. points[v]: its split points, lifted;
    ranges[v][i, j]: least and largest distance of split point i from rows below child j; absent nodes are leaves."""

    length: int
    norm2: float
    points: dict[int, np.ndarray]
    ranges: dict[int, np.ndarray] | None = None

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        left = np.maximum(self.norm2 - (rows**2).sum(1), 0)
        return np.hstack([rows, np.sqrt(left)[:, None]])

    def down(self, lifted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, distances, nearest split point), level by level, for rows that fall into a node."""
        at = np.zeros(len(lifted), "i8")
        alive = np.arange(len(lifted))
        while len(alive):
            going = []
            for node in np.unique(at[alive]):
                rows = alive[at[alive] == node]
                if node in self.points:
                    far = distances(lifted[rows], self.points[node])
                    near = far.argmin(1)
                    at[rows] = 1 + FANOUT * node + near
                    going.append(rows)
                    yield node, rows, far, near
            alive = np.concatenate(going) if going else np.empty(0, "i8")

    def leaves(self, lifted: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        at = np.zeros(len(lifted), "i8")
        for node, rows, _, near in self.down(lifted):
            at[rows] = 1 + FANOUT * node + near
        return at

    def meeting(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places): leaves that may hold rows within the annuli, given as [anchor, window], and which anchors ask."""
        waiting = [(0, np.arange(len(anchors)))]
        while waiting:
            node, rows = waiting.pop()
            if node not in self.points:
                yield node, rows
                continue
            far = distances(anchors[rows], self.points[node])  # of split points from anchors
            low, high = self.ranges[node][..., 0], self.ranges[node][..., 1]  # [split point, child]
            meets = np.zeros((len(rows), far.shape[1]), bool)
            for w in range(inner.shape[1]):
                a, b = inner[rows, w][:, None], outer[rows, w][:, None]
                least = np.maximum(np.maximum(a - far, far - b), 0) - SLACK * (1 + far)
                most = far + b + SLACK * (1 + far)
                meets |= ((low[None] <= most[..., None]) & (high[None] >= least[..., None])).all(1) & (a <= b)
            for child in range(far.shape[1]):
                if meets[:, child].any():
                    waiting.append((1 + FANOUT * node + child, rows[meets[:, child]]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0))


def far_apart(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` distinct rows, each the farthest from those before it."""
    chosen = [0]
    left = distances(rows, rows[:1])[:, 0]
    while len(chosen) < most and left.max() > SLACK:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def grown(sample: np.ndarray, norm2: float, levels: int) -> Tree:
    """A tree of up to `levels` levels over a sample; nodes of too few distinct rows stay leaves."""
    tree = Tree(sample.shape[1], norm2, {})
    waiting = [(0, 0, tree.lifted(sample))]
    while waiting:
        node, level, rows = waiting.pop()
        if level == levels or len(rows) < 2 * FANOUT:
            continue
        points = far_apart(rows, FANOUT)
        if len(points) < 2:
            continue
        tree.points[node] = points
        near = distances(rows, points).argmin(1)
        waiting += [(1 + FANOUT * node + j, level + 1, rows[near == j]) for j in range(len(points))]
    return tree


def floors(vectors, scale: float) -> np.ndarray:
    return np.floor(scale * np.stack(vectors).astype("f8"))


def with_ranges(rows: DataFrame, tree: Tree, scale: float) -> Tree:
    """The tree with the ranges of all rows (leaf, v): a task returns a row for each split point and child it met."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = {}, shared.value
        for batch in batches:
            for node, _, far, near in tree.down(tree.lifted(floors(batch["v"], scale))) if len(batch) else ():
                low, high = held.setdefault(node, (np.full((far.shape[1],) * 2, np.inf), np.full((far.shape[1],) * 2, -np.inf)))
                for child in np.unique(near):
                    mine = far[near == child]
                    low[:, child] = np.minimum(low[:, child], mine.min(0))
                    high[:, child] = np.maximum(high[:, child], mine.max(0))
        for node, (low, high) in held.items():
            i, j = np.nonzero(low <= high)
            yield pd.DataFrame({"node": node, "i": i, "j": j, "low": low[i, j], "high": high[i, j]})

    found = rows.select("v").mapInPandas(ranges, "node long, i long, j long, low double, high double")
    found = found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # 273 nodes of 256 pairs at most
    tree.ranges = {node: np.stack([np.full((len(p),) * 2, np.inf), np.full((len(p),) * 2, -np.inf)], -1) for node, p in tree.points.items()}
    for r in found:
        tree.ranges[r.node][r.i, r.j] = r.low, r.high
    return tree


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def as_double(x: int) -> float:
    return float(max(-(10**300), min(10**300, x)))


class Scores:
    """Scores of some anchors and candidates: exact numbers in arrays, of Python integers where components are large."""

    def __init__(self, anchors, rows, scale: float):
        length = len(rows[0])
        bound = math.sqrt(2**53 / length) / scale - 1  # products of smaller components, and their sums, stay below 2^53
        self.wide = any(np.abs(np.stack(x)).max() >= bound for x in (anchors, rows))
        if self.wide:
            self.anchors, self.rows = ([[whole(x, scale) for x in v] for v in side] for side in (anchors, rows))
        else:
            self.anchors, self.rows = floors(anchors, scale), np.ascontiguousarray(floors(rows, scale).T)

    def of(self, anchors: np.ndarray) -> np.ndarray:
        if not self.wide:
            return self.anchors[anchors] @ self.rows
        out = np.empty((len(anchors), len(self.rows)), object)
        for i, a in enumerate(anchors):
            out[i] = [sum(map(operator.mul, self.anchors[a], v)) for v in self.rows]
        return out


def ranked(scores: np.ndarray) -> np.ndarray:
    """Places by descending score; equal ones keep their order."""
    return np.array(sorted(range(len(scores)), key=lambda p: -scores[p]), "i8") if scores.dtype == object else np.argsort(-scores, kind="stable")


OUT = ["anchor", "slot", "id", "row", "score", "key"]
OUT_SCHEMA = "anchor long, slot int, id long, row long, score string, key string"


def _scored(asked: pd.DataFrame, held: pd.DataFrame, scale: float, pick) -> pd.DataFrame:
    """What pick(anchor, scores, labels, rows) yields as (slot, place), for anchors of a group and candidates of their length."""
    out = []
    if not len(asked) or not len(held):  # a side without rows comes without columns
        return pd.DataFrame(columns=OUT)
    sizes = held["v"].map(len)
    for length, some in asked.groupby(asked["v"].map(len)):
        rows = held[sizes == length].sort_values(["id", "row"], na_position="first")
        if not len(rows):
            continue
        ids, at, labels = rows["id"].tolist(), rows["row"].to_numpy(), rows["label"].to_numpy()
        scores = Scores(some["v"].tolist(), rows["v"].tolist(), scale)
        for part in np.array_split(np.arange(len(some)), -(-len(some) * len(rows) // STEP)):
            for i, found in zip(part, scores.of(part), strict=True):
                anchor = some.iloc[i]
                for slot, place in pick(anchor, found, labels, at):
                    score = int(found[place])
                    out.append((anchor["row"], slot, None if pd.isna(ids[place]) else int(ids[place]), at[place], str(score), wide_key(score)))
    frame = pd.DataFrame(out, columns=OUT)
    return frame.assign(id=frame["id"].astype("Int64"))


class Search:
    """One search over stored rows: a tree, tiles of its leaves, and rounds of anchors against them."""

    def __init__(self, scratch: Scratch, vectors: DataFrame, id: str, vector: str, label: str, is_anchor: Column, copies: int, scale: float):
        spark, self.scale, self.scratch = scratch.spark, scale, scratch
        v = F.col(vector).cast("array<double>")
        rows = vectors.where(usable(F.col(vector)) & F.col(label).isNotNull()).select(
            F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("a"), v.alias("v"), F.monotonically_increasing_id().alias("row")
        )
        rows = scratch.stored(rows)  # row numbers are fixed from here on
        small = ~F.exists("v", lambda x: F.abs(x) >= F.sqrt(F.lit(2.0**53) / F.size("v")) / scale - 1)
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale), F.lit(2)))
        lengths = rows.where(small).groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max(norm2).alias("norm2"))
        common = lengths.orderBy(F.desc("n"), "length").first()
        self.blocks = shards(rows.where("a").count(), BLOCK)
        fits = small & (F.size("v") == common.length) if common else F.lit(False)
        self.anchors = rows.where("a").select("row", "id", "label", "v", fits.alias("fits"))
        rows = rows.withColumn("fits", fits)
        self.tree = Tree(0, 0.0, {})
        if common:
            most = max(2 * FANOUT, min(SAMPLE, SAMPLE_VALUES // common.length))
            levels = next((k for k in range(1, LEVELS) if common.n <= LEAF * FANOUT**k), LEVELS)
            drawn = F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < 1_000_003 * min(1.0, 1.1 * most / common.n)
            taken = rows.where(F.col("fits") & drawn).select("v").limit(most).toPandas()["v"]
            if len(taken):
                self.tree = grown(floors(taken, scale), float(common.norm2), levels)
            self.tree.norm2, self.tree.length = float(common.norm2), common.length
        shared = spark.sparkContext.broadcast(self.tree)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                leaf, fit = np.full(len(batch), ODD, "i8"), batch["fits"].to_numpy(bool)
                if fit.any():
                    leaf[fit] = shared.value.leaves(shared.value.lifted(floors(batch["v"][fit], scale)))
                yield batch[["id", "label", "row", "v"]].assign(leaf=leaf)

        first = Window.partitionBy("v", "label").orderBy("id", "row")
        rows = rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= copies)
        self.rows = scratch.stored(rows.select("id", "label", "row", "v", "fits").mapInPandas(placed, "id long, label long, row long, v array<double>, leaf long"))
        self.tree = with_ranges(self.rows.where(F.col("leaf") != ODD), self.tree, scale)
        sizes = self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))  # 4,097 rows at most
        self.sizes = F.broadcast(scratch.stored(sizes))

    def asked(self, anchors: DataFrame, extra: str, windows) -> DataFrame:
        """anchors (row, label, v, fits, ...) with each leaf that they visit; windows(tree, batch, lifted) yields (leaf, places)
        of the batch's anchors that the tree can hold."""
        shared = self.scratch.spark.sparkContext.broadcast(self.tree)
        scale, columns = self.scale, [f.split()[0] for f in extra.split(", ") if f]

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = shared.value
            inner = {c for node in tree.points for c in (1 + FANOUT * node + j for j in range(len(tree.points[node])))} - set(tree.points)
            everywhere = sorted(inner or {0})
            for batch in batches:
                keep = batch[["row", "label", "v", *columns]]
                fit = np.flatnonzero(batch["fits"].to_numpy(bool))
                odd = np.flatnonzero(~batch["fits"].to_numpy(bool))
                if len(odd):
                    for leaf in everywhere:
                        yield keep.iloc[odd].assign(leaf=leaf)
                yield keep.assign(leaf=ODD)
                if len(fit):
                    some = batch.iloc[fit]
                    rows = floors(some["v"], scale)
                    for leaf, places in windows(tree, some, np.hstack([rows, np.zeros((len(rows), 1))])):
                        if len(places):
                            yield keep.iloc[fit[places]].assign(leaf=leaf)

        schema = "row long, label long, v array<double>, " + (extra + ", " if extra else "") + "leaf long"
        return anchors.select("row", "label", "v", "fits", *columns).mapInPandas(visits, schema)

    def compared(self, asked: DataFrame, pick) -> DataFrame:
        """Rows (anchor, slot, id, row, score, key) that pick chose in the leaves asked for."""
        scale, blocks = self.scale, self.blocks
        each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        left = asked.join(self.sizes, "leaf").withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)), "tile": each}).drop("tiles")
        tile = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")
        right = self.rows.join(self.sizes, "leaf").withColumns({"tile": tile, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
        right = right.select(*(F.col(c).alias(c) for c in ("leaf", "tile", "block", "id", "label", "row", "v")))
        keys = ["leaf", "tile", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _scored(a, b, scale, pick), OUT_SCHEMA)

    def best(self, found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("key"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def positives(self, most: int) -> DataFrame:
        """(anchor, slot, id, row, score, key, rank): the best rows of each anchor's own label."""

        def pick(anchor, scores, labels, at):
            same = np.flatnonzero((labels == anchor["label"]) & (at != anchor["row"]))
            return [(0, same[p]) for p in ranked(scores[same])[:most]]

        def nearest(tree, batch, lifted):
            leaf = tree.leaves(lifted)
            for one in np.unique(leaf):
                yield one, np.flatnonzero(leaf == one)

        seeds = self.scratch.stored(self.best(self.compared(self.asked(self.anchors, "", nearest), pick), most).drop("rank"))
        bounds = seeds.groupBy("anchor").agg(F.when(F.count("*") >= most, F.min_by("score", "key")).alias("least"))
        anchors = self.anchors.join(bounds, self.anchors.row == bounds.anchor, "left").select("row", "label", "v", "fits", "least")

        def ball(tree, batch, lifted):
            least = np.array([np.nan if s is None else as_double(int(s)) for s in batch["least"]])
            far2 = (lifted**2).sum(1) + tree.norm2 - 2 * least
            outer = np.where(np.isnan(far2), np.inf, np.sqrt(np.maximum(far2, 0)))[:, None]
            seen = tree.leaves(lifted)
            for leaf, places in tree.meeting(lifted, np.zeros_like(outer), outer):
                yield leaf, places[seen[places] != leaf]

        more = self.asked(anchors.where(F.col("fits")), "least string", ball).where(F.col("leaf") != ODD)
        found = self.compared(more.drop("least"), pick)
        return self.scratch.stored(self.best(seeds.unionByName(found), most))

    def negatives(self, positives: DataFrame, most: int, low: int, high: int) -> DataFrame:
        """(anchor, slot, id, row, score, key, rank): for the positive of rank `slot`, the best rows within its window."""
        held = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("held"))  # five at most
        anchors = self.anchors.join(held, self.anchors.row == held.anchor).select("row", "label", "v", "fits", F.col("held.score").alias("scores"))

        def annuli(tree, batch, lifted):
            width = max(map(len, batch["scores"]))
            base = (lifted**2).sum(1) + tree.norm2
            inner, outer = np.full((len(batch), width), np.inf), np.full((len(batch), width), -np.inf)
            for i, scores in enumerate(batch["scores"]):
                for w, score in enumerate(scores):
                    a, b = window(int(score), low, high)
                    if a <= b:
                        inner[i, w], outer[i, w] = (math.sqrt(max(0.0, base[i] - 2 * as_double(s))) for s in (b, a))
            yield from tree.meeting(lifted, inner, outer)

        def pick(anchor, scores, labels, at):
            other = np.flatnonzero(labels != anchor["label"])
            places = other[ranked(scores[other])]
            falling = [-s for s in scores[places]] if scores.dtype == object else -scores[places]
            for slot, score in enumerate(anchor["scores"], 1):
                a, b = window(int(score), low, high)
                start = np.searchsorted(falling, -b) if a <= b else len(places)
                for place in places[start : start + most]:
                    if scores[place] >= a:
                        yield slot, place

        return self.best(self.compared(self.asked(anchors, "scores array<string>", annuli), pick), most)


def mine(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that is_anchor holds for
    and each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is
    `low` to `high` percent of the positive's."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    search = Search(scratch, vectors, id, vector, label, is_anchor, positives + 1, scale)
    same = search.positives(positives)
    found = search.negatives(same, negatives, low, high)
    whose = same.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("p_score"))
    ids = search.anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))

    def number(score: str) -> Column:  # the nearest 64-bit number
        return F.coalesce(F.col(score).try_cast("long"), F.when(F.startswith(score, F.lit("-")), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)))

    met = found.join(whose, ["anchor", "slot"]).join(ids, "anchor")
    return scratch.cleared(met.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), number("p_score").alias("positive_score"), number("score").alias("negative_score")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.r, c.vec_id, c.r AS cr, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS FIRST, cr) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id NULLS FIRST, s.cr) AS INTEGER) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
