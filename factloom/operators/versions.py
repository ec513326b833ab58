"""Version histories: numbering, closing, change classes, as-of lookups, duplicates and occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_versions(rows: DataFrame, by: str, at: str, id: str) -> DataFrame:
    """rows with version (from 1), recorded_at and closed_at, the time of the next version."""
    w = Window.partitionBy(by).orderBy(at, id)
    return rows.withColumns({"version": F.row_number().over(w), "recorded_at": F.col(at), "closed_at": F.lead(at).over(w)})


def change_class(rows: DataFrame, by: str, at: str, id: str, status: str, value: str) -> DataFrame:
    """rows with `operation`: how each version differs from the one before it.

    RESTORE: active after another status; CONFLICT, SUPPRESS, DELETE: the new status; SUPERSEDE: another value;
    REFINE: the same value in other words (case or signs); MERGE_EVIDENCE: only its strength grew; NOOP: the same."""
    w = Window.partitionBy(by).orderBy(at, id)
    before = F.lag(F.struct(F.col(status).alias("status"), F.col(value).alias("value"), F.col("strength").alias("strength"))).over(w)
    rows = rows.withColumn("_before", before)
    old = F.col("_before")
    bare = F.regexp_replace(F.lower(F.col(value)), "[^a-z0-9]+", "")
    old_bare = F.regexp_replace(F.lower(old["value"]), "[^a-z0-9]+", "")
    operation = (
        F.when(old.isNull(), "ADD")
        .when((F.col(status) == "active") & (old["status"] != "active"), "RESTORE")
        .when((F.col(status) == "conflicted") & (old["status"] != "conflicted"), "CONFLICT")
        .when((F.col(status) == "suppressed") & (old["status"] != "suppressed"), "SUPPRESS")
        .when((F.col(status) == "deleted") & (old["status"] != "deleted"), "DELETE")
        .when(bare != old_bare, "SUPERSEDE")
        .when(F.col(value) != old["value"], "REFINE")
        .when(F.col("strength") > old["strength"], "MERGE_EVIDENCE")
        .otherwise("NOOP")
    )
    return rows.withColumn("operation", operation).drop("_before")


def version_as_of(versions: DataFrame, by: str, at: Column) -> DataFrame:
    """The version of each key that was open at a time: the newest recorded by then. One aggregation, no sort."""
    known = versions.where(F.col("recorded_at") <= at)
    best = known.groupBy(by).agg(F.max_by(F.struct(*(c for c in versions.columns if c != by)), F.struct("recorded_at", "version")).alias("v"))
    return best.select(by, "v.*")


def replayed(log: DataFrame, by: str, seq: str, op: str = "op") -> DataFrame:
    """Latest image of each key of an ordered log of upserts and deletes; deleted keys are gone."""
    last = log.groupBy(by).agg(F.max_by(F.struct(*(c for c in log.columns if c != by)), seq).alias("v"))
    return last.where(F.col("v")[op] != "delete").select(by, "v.*")


def occurrence_survivors(rows: DataFrame, by: list[str], at: str, id: str) -> DataFrame:
    """rows with survivor_id (the earliest of its occurrence) and is_duplicate."""
    first = F.min(F.struct(at, id)).over(Window.partitionBy(*by))[id]
    return rows.withColumn("survivor_id", first).withColumn("is_duplicate", F.col(id) != F.col("survivor_id"))


def revisions(rows: DataFrame, by: list[str], at: str, id: str, content: str) -> DataFrame:
    """Registered inputs: revision counts the content changes of an identity; rows equal to the one before are no-ops."""
    w = Window.partitionBy(*by).orderBy(at, id)
    changed = F.coalesce((~F.col(content).eqNullSafe(F.lag(content).over(w))).cast("int"), F.lit(1))
    rows = rows.withColumn("_changed", F.when(F.row_number().over(w) == 1, 1).otherwise(changed))
    return rows.withColumns({"revision": F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)), "is_noop": F.col("_changed") == 0}).drop("_changed")
