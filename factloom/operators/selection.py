"""Greedy selection per query: diversity cut, adaptive batches, minimal sufficient evidence.

Greedy choice is not associative, so that each query's candidates meet in one task, after a distributed cut to MOST rows
a query: the operators' stated candidate window, which bounds a group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 256
CHOSEN = "query_id long, id long, place int, score double, reason string"


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def chosen_per_query(candidates: DataFrame, choose: Callable[[list[dict]], list[tuple[dict, str]]], most: int = MOST) -> DataFrame:
    """candidates (query_id, id, score, tokens, chars) -> what choose() picks of each query's best `most`, in order."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    window = candidates.withColumn("rank", rank).where(F.col("rank") <= most)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("rank").to_dict("records")
        for r in ordered:
            r["tokens"] = set(r["tokens"])
        picked = choose(ordered)
        return pd.DataFrame([(r["query_id"], r["id"], i + 1, r["score"], why) for i, (r, why) in enumerate(picked)], columns=["query_id", "id", "place", "score", "reason"])

    return window.groupBy("query_id").applyInPandas(run, CHOSEN)


def diverse(k: int, most_alike: float = 0.9) -> Callable[[list[dict]], list[tuple[dict, str]]]:
    """Down the ranking: a row goes if its tokens are too much like those of a kept one."""

    def choose(rows):
        kept: list[dict] = []
        for r in rows:
            if len(kept) == k:
                break
            if all(_jaccard(r["tokens"], o["tokens"]) <= most_alike for o in kept):
                kept.append(r)
        return [(r, "diverse") for r in kept]

    return choose


def adaptive(k: int, batch: int = 4, chars: int = 6000, narrow: float = 0.86, novelty: float = 0.25) -> Callable[[list[dict]], list[tuple[dict, str]]]:
    """In batches: the first row, then rows near the best score that bring new tokens; ends with the first batch that
    brings nothing, at k rows, or when the characters are spent."""

    def choose(rows):
        kept, seen, spent = [], set(), 0
        for at in range(0, len(rows), batch):
            added = 0
            for r in rows[at : at + batch]:
                new = len(r["tokens"] - seen) / max(1, len(r["tokens"]))
                first = not kept
                if not first and (r["score"] < narrow * rows[0]["score"] or new < novelty):
                    continue
                if len(kept) == k or spent + r["chars"] > chars and not first:
                    return kept
                kept.append((r, "first" if first else "novel"))
                seen |= r["tokens"]
                spent += r["chars"]
                added += 1
            if not added:
                break
        return kept

    return choose


def sufficient(wanted: Callable[[dict], set], k: int, least_gain: float = 0.08) -> Callable[[list[dict]], list[tuple[dict, str]]]:
    """Greedy by 0.72 x marginal gain + 0.28 x relative score. Gain: 0.70 x newly covered requirement tokens, 0.20 x
    distance from what is kept, 0.10 x new tokens. Ends when all is covered, at k, or below the least gain."""

    def choose(rows):
        kept: list[tuple[dict, str]] = []
        need = wanted(rows[0]) if rows else set()
        covered, seen, left = set(), set(), list(rows)
        while left and len(kept) < k and (need - covered or not kept):
            best = None
            for r in left:
                gain = (
                    0.70 * len((r["tokens"] & need) - covered) / max(1, len(need)) + 0.20 * (1 - max((_jaccard(r["tokens"], o["tokens"]) for o, _ in kept), default=0.0))
                    + 0.10 * len(r["tokens"] - seen) / max(1, len(r["tokens"]))
                )
                value = 0.72 * gain + 0.28 * r["score"] / max(rows[0]["score"], 1e-9)
                if best is None or value > best[0] + 1e-12:
                    best = (value, gain, r)
            _, gain, r = best
            if gain < least_gain and kept:
                break
            kept.append((r, "covers" if (r["tokens"] & need) - covered else "adds"))
            covered |= r["tokens"] & need
            seen |= r["tokens"]
            left.remove(r)
        return kept

    return choose
