"""Hierarchical recall: summaries lead to facts, facts lie in tiers, and the cold tier is read for open requests alone.

Postings and hashed vectors of facts are stored in a folder for each tier. The first stage reads hot and warm folders, and
the cold one for requests that ask for the past or for everything. Requests that it leaves open, without enough evidence,
are what the second stage reads the cold folder for: a semi-join on their owners, and a new ranking of those requests only.
Statistics (document frequencies, lengths) are those of all facts of an owner, so that both stages score alike.

Evidence is absolute: a request whose best evidence is below the least of its intent has no answer. Ties go to the smaller
id. Requests must be planned (hybrid.planned)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import cues, scores
from factloom.functions.hashing import hashed_vector
from factloom.functions.text import lexical_tokens
from factloom.operators import hybrid
from factloom.operators.recall import tier_budgets
from factloom.operators.tables import keyed

# Least scores of candidates and of summaries, what a summary adds, the share of an intent's least evidence that
# a fact needs of its own to be led to, and what a key says about a concept.
LEAST_LEXICAL, LEAST_SEMANTIC, LEAST_SUMMARY, SUMMARY_WEIGHT, OWN_SHARE = 0.12, 0.08, 0.28, 0.25, 0.5
ENUMERATED, SAME_KEY, RELATED_KEY, ANY_PREFERENCE = 0.72, 1.0, 0.86, 0.65
TIERS = ("hot", "warm", "cold")


def concept_evidence(key: Column, concepts: Column, intent: Column) -> Column:
    """How far a fact's key answers the concepts asked for."""
    named = F.exists(concepts, lambda c: F.startswith(c, F.lit("preference.")) & (c != cues.GENERAL))
    related = F.exists(concepts, lambda c: F.startswith(key, F.concat(c, F.lit("."))) | F.startswith(c, F.concat(key, F.lit("."))))
    return (
        F.when(intent == "enumerative", ENUMERATED).when(F.array_contains(concepts, key), SAME_KEY)
        .when(F.array_contains(concepts, cues.GENERAL) & ~named & F.startswith(key, F.lit("preference.")), ANY_PREFERENCE).when(related, RELATED_KEY).otherwise(0.0)
    )


def routed(requests: DataFrame) -> DataFrame:
    """planned requests with the cold tier's policy, the budget of each tier, the number of summaries and the least evidence."""
    policy = F.when(F.col("intent") == "external", "disabled").when((F.col("mode") != "current") | F.col("intent").isin("timeline", "temporal", "enumerative"), "eager").otherwise("fallback")
    lanes = F.greatest(F.lit(8), F.least(F.lit(256), F.col("budget")))
    rows = requests.withColumns({"policy": policy, "lanes": lanes}).withColumn("tiers", tier_budgets(F.col("lanes"), F.col("policy")))
    summaries = F.greatest(F.lit(4), F.least(F.lit(24), F.ceil(F.col("lanes") / 4)))
    return keyed(rows.withColumns({"summaries": summaries, "least": hybrid._by_intent(F.col("intent"), 6)}), "routed")


def tier_of(status: Column, assigned: Column) -> Column:
    """quarantine, or cold for what is no longer active, or the assigned tier; warm where none is assigned."""
    return F.when((status == "quarantined") | (assigned == "quarantine"), "quarantine").when(status != "active", "cold").when(assigned.isin(*TIERS), assigned).otherwise("warm")


class Index:
    """Stored tables of facts (owner, id, content, key, status, importance, confidence, utility, assigned) and of summaries
    (owner, id, content, facts): postings, frequencies, lengths and hashed vectors."""

    def __init__(self, facts: DataFrame, summaries: DataFrame):
        live = F.col("status") == "active"
        rows = facts.withColumns({"tier": tier_of(F.col("status"), F.col("assigned")), "live": live, "tokens": lexical_tokens("content"), "dims": hashed_vector("content", hybrid.DIMS, cues.concepts(F.col("content")))})
        self.facts = keyed(rows.where(F.col("tier") != "quarantine"), "tiered", folders="tier")
        self.posted, self.frequencies, self.sizes = self._lexical(self.facts, "tier", "live")
        self.vectors = self.facts.select("owner", "id", "tier", "live", "dims")
        held = summaries.withColumns({"live": F.lit(True), "tokens": lexical_tokens("content"), "dims": hashed_vector("content", hybrid.DIMS, cues.concepts(F.col("content")))})
        self.summaries = keyed(held, "summaries")
        self.s_posted, self.s_frequencies, self.s_sizes = self._lexical(self.summaries, None, "live")
        self.s_vectors = self.summaries.select("owner", "id", "live", "dims")

    @staticmethod
    def _lexical(rows: DataFrame, tier: str | None, live: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        by = ["owner", "id", live, *([tier] if tier else [])]
        posted = rows.select(*by, F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy(*by, "length", "token").agg(F.count("*").alias("tf"))
        posted = keyed(posted, "tier-postings", folders=tier)
        frequencies = keyed(posted.groupBy("owner", "token").agg(F.count("*").alias("df_all"), F.count_if(live).alias("df_live")), "frequencies")
        size = F.size("tokens")
        sizes = rows.groupBy("owner").agg(F.count("*").alias("n_all"), F.count_if(live).alias("n_live"), F.sum(size).alias("len_all"), F.sum(F.when(F.col(live), size).otherwise(0)).alias("len_live"))
        return posted, frequencies, keyed(sizes, "sizes")


def _allowed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("live") | (F.col("mode") != "current"))


def lexical(requests: DataFrame, posted: DataFrame, frequencies: DataFrame, sizes: DataFrame, *more: str) -> DataFrame:
    """(request_id, id, more, lexical): squashed BM25 of the postings given, by the statistics given."""
    terms = requests.select("owner", "request_id", "mode", F.explode(F.array_distinct(lexical_tokens("text"))).alias("token"))
    met = _allowed(terms.join(posted, ["owner", "token"])).join(frequencies, ["owner", "token"]).join(sizes, "owner")
    n, d, total = (F.when(F.col("mode") == "current", F.col(f"{c}_live")).otherwise(F.col(f"{c}_all")) for c in ("n", "df", "len"))
    weight = F.col("tf") * (hybrid.K1 + 1) / (F.col("tf") + hybrid.K1 * (1 - hybrid.B + hybrid.B * F.col("length") / (total / n)))
    score = F.round(1 - F.exp(-F.sum(F.log1p((n - d + 0.5) / (d + 0.5)) * weight)), 9)
    return met.groupBy("request_id", "id", *more).agg(score.alias("lexical"))


def semantic(requests: DataFrame, vectors: DataFrame, *more: str) -> DataFrame:
    asked = requests.select("owner", "request_id", "mode", hashed_vector("text", hybrid.DIMS, F.col("concepts")).alias("asked"))
    return hybrid.similar(_allowed(asked.join(vectors, "owner")), *more)


def _ranked(rows: DataFrame, by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def leading(requests: DataFrame, index: Index) -> DataFrame:
    """(request_id, owner, summary_id, place, evidence): the best summaries of each request, with evidence enough to lead."""
    lex = lexical(requests, index.s_posted, index.s_frequencies, index.s_sizes).where(F.col("lexical") >= LEAST_LEXICAL)
    sem = semantic(requests, index.s_vectors).where(F.col("semantic") >= LEAST_SEMANTIC)
    lanes = requests.select("request_id", "owner", "lanes", "summaries")
    cut = [d.join(lanes, "request_id").withColumn("n", _ranked(d, ["request_id"], F.desc(c), F.asc("id"))).where(F.col("n") <= F.col("lanes")).select("request_id", "id", c) for d, c in ((lex, "lexical"), (sem, "semantic"))]
    both = cut[0].join(cut[1], ["request_id", "id"], "full").join(lanes, "request_id")
    both = both.withColumn("evidence", F.round(scores.combined_evidence(F.array("lexical", "semantic")), 9)).where(F.col("evidence") >= LEAST_SUMMARY)
    return both.withColumn("place", _ranked(both, ["request_id"], F.desc("evidence"), F.asc("id"))).where(F.col("place") <= F.col("summaries")).select("request_id", "owner", F.col("id").alias("summary_id"), "place", "evidence")


def candidates(requests: DataFrame, index: Index, tiers: tuple[str, ...]) -> DataFrame:
    """(request_id, id, tier, lexical, semantic, structured): what the folders of these tiers give, within each tier's budget."""
    def within(rows: DataFrame, score: str, *order: Column) -> DataFrame:
        budget = F.when(F.col("tier") == "hot", F.col("tiers.hot")).when(F.col("tier") == "warm", F.col("tiers.warm")).otherwise(F.col("tiers.cold"))
        met = rows.join(requests.select("request_id", "tiers"), "request_id")
        return met.withColumn("n", _ranked(met, ["request_id", "tier"], *order)).where(F.col("n") <= budget).select("request_id", "id", "tier", score)

    here = F.col("tier").isin(*tiers)
    lex = lexical(requests, index.posted.where(here), index.frequencies, index.sizes, "tier").where(F.col("lexical") >= LEAST_LEXICAL)
    sem = semantic(requests, index.vectors.where(here), "tier").where(F.col("semantic") >= LEAST_SEMANTIC)
    asks = requests.where((F.size("concepts") > 0) | (F.col("intent") == "enumerative")).select("request_id", "owner", "mode", "intent", "concepts")
    # an owner's facts by key: a request for a concept meets the few keys that answer it, one for everything the best facts
    key = F.coalesce("key", "kind")
    best = index.facts.where(here).withColumns({"key": key, "n": _ranked(index.facts, ["owner", "live", "tier"], F.desc("utility"), F.asc("id"))})
    keys = best.select("owner", "key").distinct()
    answers = asks.join(keys, "owner").withColumn("structured", concept_evidence(F.col("key"), F.col("concepts"), F.col("intent"))).where(F.col("structured") > 0).select("request_id", "owner", "mode", "intent", "key", "structured")
    met = _allowed(answers.join(best.select("owner", "key", "id", "tier", "live", "utility", "n"), ["owner", "key"]).where((F.col("intent") != "enumerative") | (F.col("n") <= 256)))
    routes = [within(lex, "lexical", F.desc("lexical"), F.asc("id")), within(sem, "semantic", F.desc("semantic"), F.asc("id")), within(met.select("request_id", "id", "tier", "utility", "structured"), "structured", F.desc("utility"), F.asc("id"))]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), routes)
    return union.groupBy("request_id", "id", "tier").agg(*(F.max(c).alias(c) for c in ("lexical", "semantic", "structured")))


def ranking(requests: DataFrame, found: DataFrame, lead: DataFrame, index: Index) -> DataFrame:
    """(request_id, id, tier, rank, evidence, routes, eligible) of candidates: each route cut to the request's budget, fused, led
    to by summaries, and held against the concepts that were asked for."""
    order = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    facts = index.facts.select("id", "owner", "content", F.coalesce("key", "kind").alias("key"), "confidence", "utility", "importance")
    rows = found.join(facts, "id").join(requests.select("request_id", "lanes", "least", "concepts", "intent"), "request_id")
    by = {"lexical": [F.desc("lexical"), F.asc("id")], "semantic": [F.desc("semantic"), F.asc("id")], "structured": [F.asc(order), F.desc("utility"), F.asc("id")]}
    for route, o in by.items():
        place = F.when(F.col(route).isNotNull(), F.row_number().over(Window.partitionBy("request_id", F.col(route).isNull()).orderBy(*o)))
        rows = rows.withColumn(f"{route}_at", F.when(place <= F.col("lanes"), place))
    rows = rows.withColumns({c: F.when(F.col(f"{c}_at").isNotNull(), F.col(c)) for c in by})
    rows = rows.withColumn("direct", F.round(scores.combined_evidence(F.array(*(F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))) for c in by))), 9))
    led = lead.join(index.summaries.select("owner", F.col("id").alias("summary_id"), F.explode("facts").alias("id")), ["owner", "summary_id"])
    led = led.groupBy("request_id", "id").agg(F.max(F.struct("evidence", (-F.col("place")).alias("p"))).alias("s")).select("request_id", "id", F.col("s.evidence").alias("summary"), (-F.col("s.p")).alias("summary_place"))
    rows = rows.join(led, ["request_id", "id"], "left").withColumn("summary", F.when(F.col("direct") >= F.col("least") * OWN_SHARE, F.col("summary")))
    led_at = F.row_number().over(Window.partitionBy("request_id", F.col("summary").isNull()).orderBy("summary_place", "id"))
    rows = rows.withColumn("summary_at", F.when(F.col("summary").isNotNull() & (led_at <= F.col("lanes")), led_at))
    names = [*by, "summary"]
    parts = [F.coalesce(1.0 / (hybrid.CONSTANT + F.col(f"{r}_at")), F.lit(0.0)) for r in names]
    rows = rows.withColumn("fused", reduce(Column.__add__, parts)).where(F.col("fused") > 0)
    evidence = F.col("direct") + SUMMARY_WEIGHT * F.coalesce(F.when(F.col("summary_at").isNotNull(), F.col("summary")), F.lit(0.0)) * (1 - F.col("direct"))
    rows = rows.withColumns({"evidence": F.round(F.least(F.lit(1.0), evidence), 6), "relative": F.col("fused") / F.max("fused").over(Window.partitionBy("request_id"))})
    score = 0.88 * F.col("evidence") + 0.06 * F.col("relative") * F.col("evidence") + 0.02 * (F.col("confidence") + F.col("utility") + F.col("importance"))
    fits = (F.col("intent") == "enumerative") | (F.size("concepts") == 0) | (concept_evidence(F.col("key"), F.col("concepts"), F.col("intent")) > 0)
    rows = rows.where(fits).withColumn("score", F.round(F.least(F.lit(1.0), score), 6))
    rows = rows.withColumn("rank", _ranked(rows, ["request_id"], F.desc("score"), F.desc("evidence"), F.asc("id"))).where(F.col("rank") <= F.col("lanes"))
    first = F.max(F.when(F.col("rank") == 1, F.col("evidence"))).over(Window.partitionBy("request_id"))
    routes = F.filter(F.array(*(F.when(F.col(f"{r}_at").isNotNull(), F.lit(r)) for r in names)), lambda x: x.isNotNull())
    return rows.select("request_id", "id", "tier", "key", "rank", "score", "evidence", routes.alias("routes"), ((first >= F.col("least")) & (F.col("evidence") >= F.col("least"))).alias("eligible"))


def still_open(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Requests that fall back on the cold tier: without an eligible fact, or, of those that ask for several things, with a
    concept that no eligible fact answers."""
    good = ranked.where("eligible").groupBy("request_id").agg(F.collect_set("key").alias("keys"))  # of at most 256 facts
    met = requests.where("policy = 'fallback'").join(good, "request_id", "left")
    answered = F.forall("concepts", lambda c: F.exists(F.coalesce("keys", F.array().cast("array<string>")), lambda k: concept_evidence(k, F.array(c), F.lit("")) > 0))
    return met.where(F.col("keys").isNull() | ((F.col("intent") == "multi-fact") & ~answered)).drop("keys")


def recalled(requests: DataFrame, index: Index) -> DataFrame:
    """(request_id, id, tier, rank, score, evidence, routes, stage): the eligible facts of routed requests."""
    asks = requests.where("policy <> 'disabled'")
    lead = keyed(leading(asks, index), "leading")
    eager = asks.where("policy = 'eager'")
    found = candidates(asks, index, ("hot", "warm")).unionByName(candidates(eager, index, ("cold",)))
    found = keyed(found, "first-stage")
    first = keyed(ranking(asks, found, lead, index), "first-ranking")
    waiting = keyed(still_open(asks, first), "open")
    cold = candidates(waiting, index, ("cold",))
    again = found.join(waiting.select("request_id"), "request_id", "left_semi").unionByName(cold)
    second = ranking(waiting, again, lead, index).withColumn("stage", F.lit(2))
    done = first.join(waiting.select("request_id"), "request_id", "left_anti").withColumn("stage", F.lit(1))
    return done.unionByName(second).where("eligible").drop("eligible", "key")
