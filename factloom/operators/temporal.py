"""Validity and transaction-time filters. Intervals are half-open; a null end is unbounded; a null start never is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def overlaps(low: Column, high: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) < high) & (F.col(end).isNull() | (F.col(end) > low))


def visible_at(at: Column, recorded: str = "recorded_at", closed: str = "closed_at") -> Column:
    return (F.col(recorded) <= at) & (F.col(closed).isNull() | (F.col(closed) > at))


def close_intervals(rows: DataFrame, by: list[str], start: str, id: str) -> DataFrame:
    """rows with valid_to (the next start of the same key), supersedes (the previous id) and status."""
    w = Window.partitionBy(*by).orderBy(start, id)
    after = F.lead(start).over(w)
    return rows.withColumns({"valid_to": after, "supersedes": F.lag(id).over(w), "status": F.when(F.lead(id).over(w).isNull(), "active").otherwise("superseded")})


def back_filled(rows: DataFrame, by: list[str], start: str, id: str, updated: str) -> DataFrame:
    """End of superseded rows that have none: the later of the next start and one second after their own, else their update time."""
    after = F.lead(start).over(Window.partitionBy(*by).orderBy(start, id))
    end = F.when(F.col("status") == "superseded", F.when(after.isNotNull(), F.greatest(after, F.col(start) + F.expr("INTERVAL 1 SECOND"))).otherwise(F.col(updated)))
    return rows.withColumn("valid_to", F.coalesce("valid_to", end))
