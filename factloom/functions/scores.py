"""Score columns: recency, frequency, temporal closeness, fused evidence, Wilson bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives in days by kind of fact.
HALF_LIVES = {"identity": 730.0, "project": 120.0, "explicit": 365.0}
OTHER_HALF_LIFE = 240.0


def recency(age_days: Column, kind: Column) -> Column:
    """0.5 ^ (age / half-life of the kind); a negative age counts as none."""
    half = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in HALF_LIVES.items()), F.lit(OTHER_HALF_LIFE))
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half)


def frequency(accesses: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(accesses) / F.log(F.lit(21.0)))


def temporal_alignment(mode: Column, is_historical: Column) -> Column:
    """history: 1 for closed rows, else 0.2; current: 1 for open rows, else 0; all: 0.7."""
    return F.when(mode == "history", F.when(is_historical, 1.0).otherwise(0.2)).when(mode == "current", F.when(is_historical, 0.0).otherwise(1.0)).otherwise(0.7)


def temporal_closeness(alignment: Column, distance_days: Column) -> Column:
    return 0.7 * alignment + 0.3 / (1 + distance_days / 365)


def combined_evidence(routes: Column) -> Column:
    """Of an array of route scores: the strongest, and parts of what it leaves by the second and third."""
    ranked = F.sort_array(F.filter(routes, lambda s: s.isNotNull()), asc=False)
    first, second, third = (F.coalesce(F.get(ranked, F.lit(i)), F.lit(0.0)) for i in range(3))
    return first + 0.16 * (1 - first) * second + 0.08 * (1 - first) * third


def learned_evidence(cosine: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.35) / 0.55))


def squashed(score: Column) -> Column:
    return 1 - F.exp(-score)


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """(low, high) of a share; 0 and 1 for an empty total."""
    n, p = total.cast("double"), successes / total.cast("double")
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    full = total > 0
    return F.struct(
        F.when(full, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0).alias("low"), F.when(full, F.least(F.lit(1.0), centre + spread)).otherwise(1.0).alias("high")
    )


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole.cast("double")).otherwise(0.0)
