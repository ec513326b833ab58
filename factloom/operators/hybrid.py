"""Hybrid recall: batches of questions over the facts of their owners, by up to six routes in one plan, and what is selected.

A question is planned first; one that needs nothing from memory leaves before any route runs. A route finds candidates by
an inverted index on (owner, term): shared tokens give BM25
scores, posting hits and the overlap of strong tokens, shared concepts their coverage, shared messages the neighbours of the best hits, and for broad questions the owner's best facts stand ready. Only the semantic
score meets every fact of the question's owner, one row a pair, as nearly every pair shares a hashed dimension. What routes find is put together by (question, fact), ranked by route within a window, and fused by reciprocal ranks.

Ties go to the smaller content, then the smaller fact id. Null texts find nothing. Questions and facts have unique ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import cues
from factloom.functions.hashing import hashed_vector
from factloom.functions.text import is_broad, lexical_tokens
from factloom.operators.tables import keyed, spread

K1, B = 1.2, 0.75
# Least scores of routes and of results, facts that a posting may have to count as a hit, seeds and neighbours
# of the episode route, and the dimensions of hashed embeddings.
LEAST_LEXICAL, LEAST_SEMANTIC, STRONG_SEMANTIC, LEAST_SCORE = 0.08, 0.2, 0.34, 0.12
POSTING, SEEDS, NEIGHBOURS, DIMS, CONSTANT, MOST = 500, 12, 60, 384, 60.0, 100


def _by_intent(intent: Column, place: int) -> Column:
    return F.coalesce(*(F.when(intent == k, F.lit(v[place])) for k, v in cues.BUDGETS.items()))


def planned(requests: DataFrame, text: str = "text") -> DataFrame:
    """requests with concepts, broad, mode (current, historical, all), intent, routes, window, budget and parts: the question
    itself and up to three clauses of it that ask for several facts. A stored table, as all routes read it."""
    low = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    rows = spread(requests).withColumns({"concepts": cues.concepts(F.col(text)), "broad": is_broad(text), "_low": low})
    timeline, past = F.col("_low").rlike(cues.TIMELINE), F.col("_low").rlike(cues.PAST)
    rows = rows.withColumn("mode", F.when(timeline, "all").when(past, "historical").otherwise("current"))
    outside = F.col("_low").rlike(cues.EXTERNAL) & ~F.col("_low").rlike(cues.PERSONAL) & (F.size("concepts") == 0) & ~F.col("broad") & ~past
    intent = (
        F.when((F.col("_low") == "") | outside, "external").when(timeline, "timeline").when(F.col("broad") & (F.size("concepts") <= 1), "enumerative")
        .when(F.col("mode") != "current", "temporal").when((F.size("concepts") > 1) | F.col("_low").rlike(cues.SEVERAL), "multi-fact").otherwise("specific")
    )
    rows = rows.withColumn("intent", intent)
    asks = F.col("intent") != "external"
    on = {
        "lexical": asks, "semantic": asks, "structured": asks & ((F.size("concepts") > 0) | (F.col("intent") == "enumerative")),
        "temporal": F.col("intent").isin("temporal", "timeline"), "correction": asks & F.col("_low").rlike(cues.CORRECTION), "episode": asks & F.col("_low").rlike(cues.EPISODE),
    }
    personal = F.col("_low").rlike(cues.PERSONAL)
    clauses = F.transform(F.split("_low", cues.SEPARATOR), lambda c: F.trim(c))
    clauses = F.slice(F.filter(clauses, lambda c: (F.length(c) >= 2) & (personal | c.rlike(cues.PERSONAL))), 1, 3)
    budget = _by_intent(F.col("intent"), 0)
    planned = rows.withColumns(
        {
            "routes": F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in on.items())), lambda r: r.isNotNull()),
            "budget": budget,
            "window": F.least(F.lit(MOST), 2 * budget),
            "parts": F.when(F.col("intent") == "multi-fact", F.concat(F.array("_low"), clauses)).otherwise(F.array("_low")),
        }
    )
    return keyed(planned.drop("_low"), "asked")


def index(facts: DataFrame) -> DataFrame:
    """facts (owner, id, content, kind, importance, confidence, status, age_days, uses, supersedes, sources) with concepts,
    tokens and hashed vectors, as a stored table that all routes read."""
    rows = facts.withColumns({"concepts": cues.concepts(F.col("content")), "tokens": lexical_tokens("content")})
    return keyed(rows.withColumns({"dims": hashed_vector("content", DIMS, F.col("concepts"))}), "facts")


def _weights(rows: DataFrame, *by: str) -> DataFrame:
    """(by, dim, weight) of hashed vectors. Never broadcast: a row for each dimension of a text looks small to the optimiser, as
    texts do in Parquet."""
    return rows.select(*by, F.inline("dims")).hint("merge")


def similar(met: DataFrame, *more: str) -> DataFrame:
    """(request_id, id, more, semantic): the inner product of the vectors `asked` and `dims` of each row that share a dimension.

    With so few dimensions nearly every pair of texts shares some: an index by dimension would have a row for each."""
    at = lambda d: F.array_position(F.col("asked.dim"), d["dim"]).cast("int") - 1
    part = lambda d: F.get(F.col("asked.weight"), at(d)) * d["weight"]
    total = F.aggregate("dims", F.lit(None).cast("double"), lambda a, d: F.coalesce(a + part(d), a, part(d)))
    # exploded, not filtered, as a filter would make it a second time
    return met.select("request_id", "id", *more, F.explode(F.array_compact(F.array(F.round(total, 9)))).alias("semantic"))


def lexical(requests: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, id, lexical), the best squashed BM25 score over a question's parts, and (request_id, id, strong, hit): the
    question shares a strong token, and one that few active facts of the owner have. A current question meets and counts the
    owner's active facts alone."""
    live = F.col("status") == "active"
    posted = facts.select("owner", "id", live.alias("live"), F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    posted = posted.groupBy("owner", "id", "live", "length", "token").agg(F.count("*").alias("tf"))
    asked = requests.select("owner", "request_id", (F.col("mode") == "current").alias("current"), F.col("window"), F.posexplode("parts").alias("part", "said"))
    terms = asked.select("owner", "request_id", "current", "window", "part", F.explode(F.array_distinct(lexical_tokens("said"))).alias("token"))
    posted = keyed(posted.join(terms.select("owner", "token").distinct(), ["owner", "token"], "left_semi"), "asked-postings")
    df = posted.groupBy("owner", "token").agg(F.count("*").alias("df_all"), F.count_if("live").alias("df_live"))
    sizes = facts.groupBy("owner").agg(F.count("*").alias("n_all"), F.count_if(live).alias("n_live"), F.sum(F.size("tokens")).alias("len_all"), F.sum(F.when(live, F.size("tokens")).otherwise(0)).alias("len_live"))
    # stored, as scores, strong tokens and seeds all come from it, and so are they: a plan would make each again for every reader
    met = keyed(terms.join(posted, ["owner", "token"]).where("live or not current").join(df, ["owner", "token"]).join(sizes, "owner"), "met")
    n, d, total = (F.when(F.col("current"), F.col(f"{c}_live")).otherwise(F.col(f"{c}_all")) for c in ("n", "df", "len"))
    idf = F.log1p((n - d + 0.5) / (d + 0.5))
    score = F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (total / n))))
    scored = met.groupBy("request_id", "part", "window", "id").agg(F.round(1 - F.exp(-score), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("request_id", "part").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("n", rank).where(F.col("n") <= F.least(F.lit(400), 4 * F.col("window"))).groupBy("request_id", "id").agg(F.max("score").alias("lexical"))
    strong = met.where((F.col("part") == 0) & ~F.startswith("token", F.lit("c:")))
    strong = strong.groupBy("request_id", "id").agg(F.lit(True).alias("strong"), F.bool_or(F.col("live") & (F.col("df_live") <= POSTING)).alias("hit"))
    return keyed(best, "lexical"), keyed(strong, "strong")


def recency(kind: Column, age_days: Column) -> Column:
    """Halves with each half-life, which the kind gives."""
    half = F.when(kind == "identity", 730.0).when(kind == "project", 120.0).when(kind == "explicit", 365.0).otherwise(240.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half)


def features(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, id, ...): the scores of every fact that some route can find, with the fact's own properties and which
    routes it is relevant for."""
    asks = requests.where("intent <> 'external'")
    lexed, strong = lexical(asks, facts)
    asked = asks.select("owner", "request_id", hashed_vector("text", DIMS, F.col("concepts")).alias("asked"))
    near = similar(asked.join(facts.select("owner", "id", "dims"), "owner"))
    weight = lambda c: F.when(c == cues.GENERAL, cues.GENERAL_WEIGHT).otherwise(1.0)
    wanted = asks.select("owner", "request_id", F.explode("concepts").alias("concept"))
    total = wanted.groupBy("request_id").agg(F.sum(weight(F.col("concept"))).alias("total"))
    covered = wanted.join(facts.select("owner", "id", F.explode("concepts").alias("concept")), ["owner", "concept"]).groupBy("request_id", "id").agg(F.sum(weight(F.col("concept"))).alias("covered"))
    covered = covered.join(total, "request_id").select("request_id", "id", F.round(F.col("covered") / F.col("total"), 9).alias("coverage"))
    quality = F.col("importance") * 0.6 + F.col("confidence") * 0.4
    order = [F.desc(F.round(quality, 9)), F.asc("content"), F.asc("id")]
    best = [facts.where(w).withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy(*order))).where(F.col("n") <= MOST).select("owner", "id") for w in ("status = 'active'", "status in ('active', 'superseded')")]
    broad = asks.where(F.col("broad") & (F.size("concepts") == 0)).select("owner", "request_id", "mode")
    stand = broad.where("mode = 'current'").join(best[0], "owner").unionByName(broad.where("mode <> 'current'").join(best[1], "owner")).select("request_id", "id", F.lit(True).alias("stands"))
    said = facts.where("status = 'active'").select("owner", "id", F.explode("sources").alias("message")).distinct()
    episodic = asks.where(F.array_contains("routes", "episode"))
    first = lexed.where(F.col("lexical") >= LEAST_LEXICAL).withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("lexical"), "id"))).where(F.col("n") <= SEEDS).select("request_id", "id")
    seeds = episodic.select("owner", "request_id").join(first.unionByName(strong.where("hit").select("request_id", "id")).distinct(), "request_id")
    beside = seeds.join(said, ["owner", "id"]).select("owner", "request_id", "message").distinct().join(said, ["owner", "message"]).select("request_id", "id").distinct()
    beside = beside.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("id"))).where(F.col("n") <= NEIGHBOURS).select("request_id", "id", F.lit(True).alias("neighbour"))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [lexed, strong, near, covered, stand, beside])
    found = found.groupBy("request_id", "id").agg(*(F.max(c).alias(c) for c in ("lexical", "semantic", "coverage")), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("strong", "hit", "stands", "neighbour")))
    facts_ = facts.select("owner", "id", "content", "kind", "importance", "confidence", "status", "age_days", "supersedes")
    plan = asks.select("request_id", "owner", "mode", "broad", "routes", "window", (F.size("concepts") > 0).alias("aimed"))
    rows = found.join(plan, "request_id").join(facts_, ["owner", "id"])
    rows = rows.where((F.col("status") == "active") | ((F.col("mode") != "current") & (F.col("status") == "superseded")))
    lex, sem = (F.coalesce(c, F.lit(0.0)) for c in ("lexical", "semantic"))
    sem = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sem))
    shared = F.coalesce(F.col("coverage"), F.lit(0.0)) > 0
    aimed = F.col("aimed")
    rows = rows.withColumns({"lexical": lex, "semantic": sem, "structured": F.when(aimed, F.coalesce("coverage", F.lit(0.0))).when(F.col("broad"), F.round(quality, 9)).when(F.col("hit"), 0.45 + F.col("importance") * 0.1).otherwise(0.0)})
    rows = rows.withColumns(
        {
            "in_lexical": (F.col("lexical") >= LEAST_LEXICAL) & F.col("strong") & (~aimed | shared),
            "in_semantic": (F.col("semantic") >= LEAST_SEMANTIC) & ((aimed & shared) | (~aimed & (F.col("strong") | (F.col("semantic") >= STRONG_SEMANTIC)))),
            "in_structured": F.when(aimed, shared).otherwise(F.col("broad") | F.col("hit")),
            "in_episode": F.array_contains("routes", "episode") & F.col("neighbour"),
            "temporal": F.when(F.col("mode") == "historical", F.when(F.col("status") == "superseded", 1.0).otherwise(0.2)).when(F.col("mode") == "current", 1.0).otherwise(0.7),
            "recency": F.round(recency(F.col("kind"), F.col("age_days")), 2),
        }
    )
    return rows.where(F.col("in_lexical") | F.col("in_semantic") | F.col("in_structured") | F.col("in_episode"))


def recalled(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, id, rank, score, routes, ...) of planned requests over indexed facts: the fused ranking of each request
    within its window, without scores below LEAST_SCORE."""
    rows = features(requests, facts)
    changed = F.when(F.col("status") == "conflicted", 1.0).when(F.col("supersedes").isNotNull(), 0.9).otherwise(0.75)
    score = {
        "lexical": F.when(F.col("in_lexical"), F.col("lexical")), "semantic": F.when(F.col("in_semantic"), F.col("semantic")), "structured": F.when(F.col("in_structured"), F.col("structured")),
        "temporal": F.when(F.col("temporal") > 0, F.col("temporal")),
        "correction": F.when(F.col("status").isin("conflicted", "superseded") | F.col("supersedes").isNotNull(), changed * 0.7 + F.col("lexical") * 0.2 + F.col("semantic") * 0.1),
        "episode": F.when(F.col("in_episode"), 0.5 + F.col("lexical") * 0.3 + (F.col("importance") + F.col("confidence")) / 2 * 0.2),
    }
    routes = F.filter(F.array(*(F.when(F.array_contains("routes", n), F.struct(F.lit(n).alias("route"), F.round(s, 9).alias("by"))) for n, s in score.items())), lambda r: r["by"].isNotNull())
    newest = F.when(F.col("route.route") == "temporal", F.col("age_days")).otherwise(0.0)
    each = rows.withColumn("route", F.explode(routes))
    place = F.row_number().over(Window.partitionBy("request_id", "route.route").orderBy(F.desc("route.by"), newest, "content", "id"))
    ranked = each.withColumn("place", place).where(F.col("place") <= F.col("window"))
    own = ["request_id", "id", "content", "kind", "importance", "confidence", "status", "lexical", "semantic", "structured", "temporal", "recency"]
    fused = ranked.groupBy(*own).agg(F.sum(1.0 / (CONSTANT + F.col("place"))).alias("fused"), F.array_sort(F.collect_list("route.route")).alias("routes"))
    whole = Window.partitionBy("request_id")
    live = ranked.groupBy("request_id").agg(F.count_distinct("route.route").alias("of_routes"))
    fused = fused.withColumn("relative", F.col("fused") / F.max("fused").over(whole)).join(live, "request_id")
    total = (
        0.78 * F.col("relative") + 0.09 * F.size("routes") / F.col("of_routes") + 0.06 * (0.45 * F.col("importance") + 0.55 * F.col("confidence")) + 0.05 * F.col("temporal") + 0.02 * F.col("recency")
    )
    scored = fused.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)).where(F.col("score") >= LEAST_SCORE)
    order = F.row_number().over(whole.orderBy(F.desc("score"), F.desc(F.size("routes")), "content", "id"))
    return scored.withColumn("rank", order).drop("fused", "relative", "of_routes")


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


CHOSEN = "request_id long, place int, id long, score double, batches int, evaluated int, stopped string"


def select(rows: list[dict], plan: dict, least_gain: float = 0.15) -> tuple[list[dict], int, int, str]:
    """(selected, batches, evaluated, why it ended) down a ranking of (content, score, concepts, tokens), in batches: a row is
    taken if it is the first, brings a concept asked for, or is near the best and new."""
    wanted = set(plan["concepts"])
    many = plan["broad"] or plan["mode"] in ("historical", "all")
    taken, covered, spent, at, batches, why = [], set(), 0, 0, 0, "candidates-exhausted"
    best = rows[0]["score"]
    while at < len(rows) and batches < plan["batches"]:
        batch = rows[at : at + (plan["later"] if batches else plan["first"])]
        at, batches, before, full = at + len(batch), batches + 1, len(taken), False
        for row in batch:
            if len(taken) >= plan["most"]:
                why, full = "max-injected", True
                break
            has = set(row["concepts"])
            match = has & wanted
            if wanted and has and not match:
                continue
            fresh = 1 - max((_alike(row["words"], o["words"]) for o in taken), default=0) if taken else 1
            near = row["score"] / best if best > 0 else 0
            if not taken:
                take = not wanted or bool(match) or (not has and near >= 0.9)
            else:
                take = bool(match - covered) or (many and (not wanted or match) and near >= 0.55 and fresh >= 0.2) or (not many and not wanted and near >= 0.86 and fresh >= 0.25)
            if not take:
                continue
            cost = min(1000, len(" ".join(row["content"].split())))
            if taken and spent + cost > plan["chars"]:
                why, full = "character-budget", True
                break
            taken.append(row)
            spent += cost
            covered |= match
        if full:
            break
        gain = len(taken) - before
        if wanted and wanted <= covered and not many:
            why = "coverage-satisfied"
        elif not gain or (batches > 1 and gain / len(batch) < least_gain):
            why = "marginal-gain"
        elif not many and len(wanted) <= 1 and not wanted:
            why = "coverage-satisfied"
        elif at < len(rows) and best > 0 and rows[at]["score"] / best < 0.45:
            why = "score-drop"
        else:
            continue
        break
    if at < len(rows) and batches >= plan["batches"] and why == "candidates-exhausted":
        why = "max-batches"
    return taken, batches, at, why


def adaptive(requests: DataFrame, ranked: DataFrame, alike: float = 0.9) -> DataFrame:
    """(request_id, place, id, score, batches, evaluated, stopped): what is selected for each planned request. One row without
    an id says why nothing is: not needed, no candidates, or a best score below the least one of the intent.

    A greedy choice depends on the rows before, so that a request's ranking meets in one task: the 100 rows of the largest
    window at most for each route, by the ranks that recalled() cut."""
    plan = requests.select("request_id", "intent", "mode", "broad", "budget", F.col("concepts").alias("wanted"), *(_by_intent(F.col("intent"), i).alias(n) for i, n in enumerate(("first", "later", "batches", "most", "chars", "least"), 1)))
    low = F.lower("content")
    words = F.concat(F.regexp_extract_all(low, F.lit(r"[a-z0-9]+|[\x{3400}-\x{9fff}]"), 0), F.transform(cues.concepts(F.col("content")), lambda c: F.concat(F.lit("concept:"), c)))
    held = ranked.select("request_id", "id", "rank", "score", "content", cues.concepts(F.col("content")).alias("concepts"), words.alias("words"), lexical_tokens("content").alias("tokens"))
    met = plan.join(held, "request_id", "left")

    def chosen(rows: list[dict]) -> list[tuple]:
        head = rows[0]
        base = {k: head[k] for k in ("mode", "broad", "first", "later", "batches", "most", "chars")} | {"concepts": head["wanted"]}
        none = lambda why: [(head["request_id"], 0, None, None, 0, 0, why)]
        if head["intent"] == "external":
            return none("memory-not-needed")
        ordered = [r for r in rows if r["id"] is not None]
        if not ordered:
            return none("no-candidates" if head["least"] <= 0 else "abstain-low-confidence")
        if ordered[0]["score"] < head["least"]:
            return none("abstain-low-confidence")
        pool: list[dict] = []
        for r in ordered:
            r["tokens"], r["words"] = set(r["tokens"]), set(r["words"])
            if len(pool) < head["budget"] and all(_alike(r["tokens"], o["tokens"]) <= alike for o in pool):
                pool.append(r)
        taken, batches, evaluated, why = select(pool, base)
        return [(head["request_id"], i + 1, r["id"], r["score"], batches, evaluated, why) for i, r in enumerate(taken)] or none(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come request by request in order of rank, as they are sorted; those of a request may go on in the next batch
        rows = (r for b in batches for i in range(0, b.num_rows, SLICE) for r in b.slice(i, SLICE).to_pylist())
        out: list[tuple] = []
        for _, of in groupby(rows, lambda r: r["request_id"]):
            out += chosen(list(of))
            if len(out) >= SLICE:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    # by a number of its own, as tasks of few bytes that are heavy by row would else be put together
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, "request_id").sortWithinPartitions("request_id", "rank").mapInArrow(run, CHOSEN)


#: Rows that are Python objects at a time.
SLICE = 1024
_CHOSEN = pa.schema([("request_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("batches", pa.int32()), ("evaluated", pa.int32()), ("stopped", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHOSEN, strict=True)], schema=_CHOSEN)


def used(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """facts with one use more for each request that selected them."""
    counts = chosen.where("id is not null").groupBy("id").agg(F.count("*").alias("_n"))
    return facts.join(counts, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")
