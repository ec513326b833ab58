"""Commands on versioned facts, supersession cycles, and relations after a new claim set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import stable_id
from factloom.operators.tables import cut

#: The status that each command leaves; an edit keeps it.
AFTER = {"suppress": "suppressed", "delete": "deleted", "purge": "purged", "restore": "active", "archive": "archived"}


def applied_commands(facts: DataFrame, commands: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """facts (fact_id, status, value) and commands (fact_id, seq, command, value) -> one row for each accepted command:
    fact_id, version (from 2), status, value, event_key. Commands whose event key is known already are left out; none
    changes a purged fact; a restore of an active fact is none."""
    key = stable_id("command", "fact_id", "seq", "command")
    rows = commands.withColumnRenamed("value", "new_value").withColumn("event_key", key)
    if known is not None:
        rows = rows.join(known.select("event_key"), "event_key", "left_anti")
    met = rows.join(facts, "fact_id")
    w = Window.partitionBy("fact_id").orderBy("seq", "event_key")
    purge_seq = F.min(F.when(F.col("command") == "purge", F.col("seq"))).over(Window.partitionBy("fact_id"))
    met = met.withColumn("_purged", purge_seq).where((F.col("status") != "purged") & (F.col("_purged").isNull() | (F.col("seq") <= F.col("_purged"))))
    left = F.coalesce(*(F.when(F.col("command") == c, F.lit(s)) for c, s in AFTER.items()))
    state = F.last(left, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.last(left, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("status"))
    text = F.last(F.when(F.col("command") == "edit", F.col("new_value")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumns({"_before": before, "_state": F.coalesce(state, F.col("status")), "_value": F.when(F.col("command") == "purge", "").otherwise(F.coalesce(text, F.col("value")))})
    kept = met.where(~((F.col("command") == "restore") & (F.col("_before") == "active")))
    return kept.select("fact_id", (F.row_number().over(w) + 1).alias("version"), "command", F.col("_state").alias("status"), F.col("_value").alias("value"), "event_key")


def cyclic(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of the nodes that some path leads on from without end: those left when nodes without outgoing edges are peeled
    off, again and again. An edge to a node with one way on is put to the end of that way, which is left if and only if the
    node is: so a chain halves in each round, and rounds grow with the logarithm of the longest chain, not with its length.
    A round in which no node goes is the last, as of nodes that can go, one leads only to ends. The driver sees counts."""
    left = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    n = left.select("src").distinct().count()
    while n:
        ways = left.groupBy(F.col("src").alias("dst")).agg(F.when(F.count("*") == 1, F.min("dst")).alias("on"))
        left = cut(left.join(ways, "dst").select("src", F.coalesce("on", "dst").alias("dst")).distinct())
        now = left.select("src").distinct().count()
        if now == n:
            break
        n = now
    return left.select(F.col("src").alias("node")).distinct()


def rebased(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """relations (relation_id, a, b, a_hash, b_hash) against the new claims (id, hash): kept, or purged with the reason."""
    ends = claims.select(F.col("id"), F.col("hash"))
    met = relations.join(ends.toDF("a", "now_a"), "a", "left").join(ends.toDF("b", "now_b"), "b", "left")
    reason = F.when(F.col("now_a").isNull() | F.col("now_b").isNull(), "missing-end").when((F.col("a_hash") != F.col("now_a")) | (F.col("b_hash") != F.col("now_b")), "changed-end")
    return met.select("relation_id", F.when(reason.isNull(), "kept").otherwise("purged").alias("action"), reason.alias("reason"))


def concepts(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of the rules whose pattern a text matches, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(n)) for n, p in sorted(rules.items()))), lambda c: c.isNotNull())
