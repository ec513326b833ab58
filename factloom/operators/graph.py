"""Claim and relation graphs as edge tables: neighbours, bounded traversal, conflicts, closures, components.

Loops advance all requests together, one join a round; each round is cut off by checkpoint() into the folder named in
spark.checkpoint.dir, and the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.tables import cut, kept


def neighbours(edges: DataFrame, direction: str = "both", symmetric: tuple[str, ...] = ()) -> DataFrame:
    """edges (src, dst, kind) -> (node, other, kind): outgoing, incoming or both; symmetric kinds count both ways in any
    direction; a self-loop is one row."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind")
    if direction == "out":
        return out.union(back.where(F.col("kind").isin(*symmetric))).distinct()
    if direction == "in":
        return back.union(out.where(F.col("kind").isin(*symmetric))).distinct()
    return out.union(back).distinct()


def shortest_paths(steps: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """steps (node, other), roots (root, node) -> (root, node, depth, parent): one shortest path for each reached node,
    through the smallest parent of the depth before."""
    found = cut(roots.select("root", "node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent")).distinct())
    frontier = found
    for depth in range(1, hops + 1):
        reached = frontier.select("root", F.col("node").alias("parent")).join(steps.select(F.col("node").alias("parent"), F.col("other").alias("node")), "parent")
        new = reached.join(found, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("parent").alias("parent"))
        frontier = cut(new.select("root", "node", F.lit(depth).alias("depth"), "parent"))
        found = found.unionByName(frontier)
    return found


def opposing(claims: DataFrame, key: list[str]) -> DataFrame:
    """claims (id, polarity, valid_from, valid_to, ...) -> pairs (a < b) of one key with opposite polarity whose validity
    overlaps, and the overlap. Equal (key, polarity, interval) rows meet once."""
    a = claims.select(*key, F.col("id").alias("a"), F.col("polarity").alias("pa"), F.col("valid_from").alias("fa"), F.col("valid_to").alias("ta")).where("pa = 'positive'")
    b = claims.select(*key, F.col("id").alias("b"), F.col("polarity").alias("pb"), F.col("valid_from").alias("fb"), F.col("valid_to").alias("tb")).where("pb = 'negative'")
    met = a.join(b, key).where("(tb is null or fa < tb) and (ta is null or fb < ta)")
    return met.select(
        *key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("fa", "fb").alias("from"), F.least("ta", "tb").alias("to")
    ).distinct()


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that each node is connected with."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(taken.join(jump, "component", "left").select("node", "old", F.coalesce("next", "component").alias("component")))
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def purge_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """edges (src, dst): dst depends on src; targets (node) -> every node that goes with them, and its round."""
    # a stored table, as every round reads the edges, and would shuffle whatever they are made of again
    edges = kept(edges.select("src", "dst"), "purge-edges")
    found = cut(targets.select("node", F.lit(0).alias("round")).distinct())
    frontier, step = found, 0
    while frontier.limit(1).count():
        step += 1
        new = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(found, "node", "left_anti").select("node", F.lit(step).alias("round")))
        found = found.unionByName(frontier)
    return found


def relation_pairs(claims: DataFrame, shared: list[str], most: int = 32) -> DataFrame:
    """claims (id, at, ...) -> (id, other, routes): pairs that share one of several blocking keys, the newer claim first,
    at most `most` partners of a claim by number of shared keys and then by id, as the operator's stated fan-out."""
    routes = [
        claims.select("id", "at", F.col(k).alias("k")).where("k is not null").join(
            claims.select(F.col("id").alias("other"), F.col("at").alias("other_at"), F.col(k).alias("k")), "k"
        ).where("(at, id) > (other_at, other)").select("id", "other", F.lit(k).alias("route"))
        for k in shared
    ]
    union = routes[0]
    for r in routes[1:]:
        union = union.union(r)
    pairs = union.groupBy("id", "other").agg(F.array_sort(F.collect_set("route")).alias("routes"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.size("routes")), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)
