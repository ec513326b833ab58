"""Claims and their surroundings: entity linking, predicate direction, evidence packs, routing, consolidation, mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import name_key


def linked_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions (mention_id, text, type) x entities (entity_id, name, type, alias) -> mention_id, entity_id, basis.

    A name that one entity of the type has resolves it; several leave it ambiguous; a canonical name goes before an alias."""
    names = entities.select("entity_id", "type", name_key("name").alias("k"), F.lit(1).alias("basis")).unionByName(
        entities.where("alias is not null").select("entity_id", "type", name_key("alias").alias("k"), F.lit(2).alias("basis"))
    )
    counted = names.groupBy("type", "k", "basis").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    best = counted.groupBy("type", "k").agg(F.min_by(F.struct("n", "entity_id", "basis"), "basis").alias("b"))
    met = mentions.withColumn("k", name_key("text")).join(best, ["type", "k"], "left")
    one = F.col("b.n") == 1
    return met.select(
        "mention_id", F.when(one, F.col("b.entity_id")).alias("entity_id"),
        F.when(F.col("b").isNull(), "unknown").when(~one, "ambiguous").when(F.col("b.basis") == 1, "name").otherwise("alias").alias("basis"),
    )


def directed(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """facts (…, predicate, subject, object) with the registry's canonical predicate; reversed ones swap their ends."""
    met = facts.join(registry.withColumnRenamed("name", "predicate"), "predicate", "left")
    swap = F.coalesce(F.col("reversed"), F.lit(False))
    return met.withColumns(
        {"canonical": F.col("canonical"), "from_id": F.when(swap, F.col("object")).otherwise(F.col("subject")), "to_id": F.when(swap, F.col("subject")).otherwise(F.col("object")), "reason": F.when(F.col("canonical").isNull(), "unknown-predicate")}
    )


def conflict_groups(facts: DataFrame, by: list[str], id: str, most: int = 8) -> DataFrame:
    """Per fact, up to `most` ids of its key around it by time, itself left out: versions that its evidence row cites."""
    w = Window.partitionBy(*by).orderBy("valid_from", id).rowsBetween(-most // 2, most // 2)
    near = F.collect_list(id).over(w)
    return facts.withColumn("conflict_ids", F.slice(F.array_sort(F.array_remove(near, F.col(id))), 1, most))


def evidence_pack(hits: DataFrame, facts: DataFrame, by: str = "query_id") -> DataFrame:
    """One nested row for each query: its facts in rank order with a citation number, and their number."""
    rows = hits.join(facts, "id").select(by, F.struct("rank", F.concat(F.lit("M"), F.col("rank")).alias("citation"), "id", *(c for c in facts.columns if c != "id")).alias("e"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("e")).alias("entries"), F.count("*").alias("n"))


def routed_reads(requests: DataFrame, primary: DataFrame, secondary: DataFrame, by: str = "query_id") -> DataFrame:
    """Which result serves each request: the primary if it has rows, else the secondary; with the reason."""
    p = primary.groupBy(by).agg(F.count("*").alias("p"))
    s = secondary.groupBy(by).agg(F.count("*").alias("s"))
    met = requests.join(p, by, "left").join(s, by, "left").na.fill(0, ["p", "s"])
    served = F.when(F.col("p") > 0, "primary").when(F.col("s") > 0, "secondary").otherwise("none")
    return met.select(by, served.alias("served"), F.when(F.col("p") > 0, F.lit(None).cast("string")).otherwise("empty").alias("reason"), F.greatest(F.col("p"), F.when(F.col("p") == 0, F.col("s")).otherwise(0)).alias("rows"))


def consolidation_actions(wanted: DataFrame, present: DataFrame, by: list[str], members: str) -> DataFrame:
    """Summaries that a run builds, rebuilds, skips or prunes: by a hash of their members."""
    w = wanted.select(*by, F.sha2(F.to_json(F.array_sort(members)), 256).alias("new"))
    p = present.select(*by, F.sha2(F.to_json(F.array_sort(members)), 256).alias("old"))
    action = F.when(F.col("new").isNull(), "prune").when(F.col("old").isNull(), "build").when(F.col("new") == F.col("old"), "skip").otherwise("rebuild")
    return w.join(p, by, "full").select(*by, action.alias("action"))


def mirror_merge(current: DataFrame, incoming: DataFrame, id: str, purged: Column, archived: Column, moved: Column) -> DataFrame:
    """current x incoming by id -> (id, action): purged rows never come back, archived ones stay unless their source moved,
    absent ones are deleted, equal ones are unchanged."""
    c = current.select(id, F.struct(*current.columns).alias("c"))
    i = incoming.select(id, F.struct(*incoming.columns).alias("i"))
    same = F.to_json("c") == F.to_json("i")
    action = (
        F.when(F.col("c").isNull(), "insert").when(F.coalesce(purged, F.lit(False)), "keep-purged").when(F.col("i").isNull(), "delete").when(same, "unchanged")
        .when(F.coalesce(archived, F.lit(False)) & ~F.coalesce(moved, F.lit(False)), "keep-archived").otherwise("update")
    )
    return c.join(i, id, "full").select(id, action.alias("action"))


def isotonic_blocks(samples: DataFrame, by: str) -> DataFrame:
    """Isotonic calibration of each cohort by pool-adjacent-violators over its distinct scores, which are counted first:
    (cohort, low, high, value, weight). A cohort's scores are as many as its rounding allows, whatever its rows."""
    import pandas as pd

    counted = samples.groupBy(by, "score").agg(F.count("*").alias("n"), F.count_if("relevant").alias("pos"))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for score, n, pos in rows.sort_values("score")[["score", "n", "pos"]].itertuples(index=False):
            blocks.append([score, score, n, pos])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
        return pd.DataFrame([(rows[by].iloc[0], a, b, p / n, n) for a, b, n, p in blocks], columns=[by, "low", "high", "value", "weight"])

    return counted.groupBy(by).applyInPandas(pool, f"{by} string, low double, high double, value double, weight long")
