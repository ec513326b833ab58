"""Audits: violations and differences as rows (rule, id, detail); no rows means no findings."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(table: DataFrame, id: str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, id) for each row and rule whose condition holds; one pass over the table."""
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda r: r.isNotNull())
    return table.select(F.explode(broken).alias("rule"), F.col(id).alias("id"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, id) of the child keys that the parent lacks."""
    return child.select(F.col(key).alias("id")).distinct().join(parent.select(F.col(parent_key).alias("id")), "id", "left_anti").select(F.lit(rule).alias("rule"), "id")


def repeated(table: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return table.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws(":", *keys).alias("id"), F.col("count").alias("n"))


def mirror_differences(source: DataFrame, mirror: DataFrame, id: str, compared: Mapping[str, Column]) -> DataFrame:
    """Full outer comparison of two tables by id: (issue, id). compared: issue name -> condition over the columns of the
    source as s_<name> and of the mirror as m_<name>."""
    s = source.select(F.col(id), F.lit(True).alias("in_s"), *(F.col(c).alias(f"s_{c}") for c in source.columns if c != id))
    m = mirror.select(F.col(id), F.lit(True).alias("in_m"), *(F.col(c).alias(f"m_{c}") for c in mirror.columns if c != id))
    both = s.join(m, id, "full")
    checks = [F.when(F.col("in_m").isNull(), "missing"), F.when(F.col("in_s").isNull(), "unexpected")]
    checks += [F.when(F.col("in_s") & F.col("in_m") & F.coalesce(cond, F.lit(False)), F.lit(issue)) for issue, cond in compared.items()]
    return both.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("issue"), F.col(id).alias("id"))


def waterfall(rows: DataFrame, checks: Mapping[str, Column], out: str = "reason") -> DataFrame:
    """rows with the first check that fails, or null: each condition says when the check fails."""
    chain = reduce(lambda c, x: c.when(F.coalesce(x[1], F.lit(True)), x[0]), list(checks.items())[1:], F.when(F.coalesce(next(iter(checks.values())), F.lit(True)), next(iter(checks))))
    return rows.withColumn(out, chain)
