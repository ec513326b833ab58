"""Maintenance jobs: feedback signals, utility, tiers, capacity, buckets and summaries, rare-token duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.tables import BROADCAST, kept

#: Rows on one side of a tile: what one task compares with as many others; documents that a task makes into tokens.
TILE, DOCS = 500, 4_000


def feedback_signals(events: DataFrame, fact: str = "fact_id", outcome: str = "outcome") -> DataFrame:
    """Counts of adopted, corrected, denied and all reports of each fact, in one pass."""
    of = lambda o: F.count_if(F.col(outcome) == o).alias(o)
    return events.where(F.col(fact).isNotNull()).groupBy(fact).agg(of("adopted"), of("corrected"), of("denied"), F.count("*").alias("accesses"))


def utility(importance: Column, evidence: Column, adopted: Column, accesses: Column, age_days: Column, unique: Column, confirmed: Column, denied: Column, corrected: Column) -> Column:
    """Weighted usefulness in [0, 1], lowered by denials and corrections, at most by one half."""
    access = F.least(F.lit(1.0), 0.25 * adopted + 0.1 * accesses)
    fresh = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / 30.0)
    lost = F.least(F.lit(0.5), 0.2 * denied + 0.1 * corrected)
    value = 0.30 * importance + 0.15 * evidence + 0.20 * access + 0.15 * fresh + 0.10 * F.when(unique, 1.0).otherwise(0.4) + 0.10 * F.when(confirmed, 1.0).otherwise(0.0) - lost
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def assigned_tiers(facts: DataFrame, by: str, id: str, hot: int = 500, warm: int = 2000, cold: int = 10_000, hot_least: float = 0.65, warm_least: float = 0.35) -> DataFrame:
    """facts (with utility, protected, quarantined) with a tier, by budgets for each owner.

    Hot: the most useful at hot_least or more. Protected rows that aren't hot are warm and use up its budget first; the
    best of the others at warm_least or more fill it; of what is left the best are cold, the rest archive candidates."""
    order = [F.desc("utility"), F.asc(id)]
    live = ~F.col("quarantined")
    pick = lambda name, cond, first=(): F.row_number().over(Window.partitionBy(by, cond).orderBy(*first, *order))
    rows = facts.withColumn("_h", live & (F.col("utility") >= hot_least))
    rows = rows.withColumn("_hot", F.col("_h") & (pick("h", F.col("_h")) <= hot))
    rows = rows.withColumn("_w", live & ~F.col("_hot") & (F.col("protected") | (F.col("utility") >= warm_least)))
    rows = rows.withColumn("_warm", F.col("_w") & (F.col("protected") | (pick("w", F.col("_w"), [F.desc("protected")]) <= warm)))
    rows = rows.withColumn("_c", live & ~F.col("_hot") & ~F.col("_warm"))
    rows = rows.withColumn("_cold", F.col("_c") & (pick("c", F.col("_c")) <= cold))
    tier = F.when(~live, "quarantine").when(F.col("_hot"), "hot").when(F.col("_warm"), "warm").when(F.col("_cold"), "cold").otherwise("archive")
    return rows.withColumn("tier", tier).drop("_h", "_hot", "_w", "_warm", "_c", "_cold")


def within_capacity(rows: DataFrame, by: list[str], most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each scope; the order must end in a unique key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def buckets(rows: DataFrame, owner: str, keys: dict[str, Column], episode: str, fact: str) -> DataFrame:
    """Distinct episodes and facts of each bucket, for several keyings at once; a null key is in no bucket of that kind."""
    keyed = F.array(*(F.struct(F.lit(name).alias("granularity"), key.cast("string").alias("bucket")) for name, key in keys.items()))
    exploded = rows.select(owner, episode, fact, F.explode(keyed).alias("k")).where("k.bucket is not null")
    return exploded.groupBy(owner, F.col("k.granularity").alias("granularity"), F.col("k.bucket").alias("bucket")).agg(
        F.count_distinct(episode).alias("episodes"), F.count_distinct(fact).alias("facts")
    )


def summaries(rows: DataFrame, by: list[str], key: str, text: str, at: str) -> DataFrame:
    """Per group: its distinct texts in time order, joined, their number, and the time range."""
    first = rows.groupBy(*by, text).agg(F.min(F.struct(at, key)).alias("first"), F.count("*").alias("n"), F.max(at).alias("last"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first", text)))
    listed = F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("text"))))
    return ranked.groupBy(*by).agg(
        F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("summary"),
        F.count("*").alias("texts"), F.sum("n").alias("rows"), F.min(F.col("first")[at]).alias("since"), F.max("last").alias("until"),
    )


def _tiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (with _tiles, _at) twice, with (_i, _j): each group, dealt by _at into tiles of about TILE rows, meets itself tile by
    tile."""
    own, all_ = F.pmod(F.col("_at"), F.col("_tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    return rows.withColumn("_i", own).withColumn("_j", all_).drop("_tiles", "_at"), rows.withColumn("_j", own).withColumn("_i", all_).drop("_tiles", "_at")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _rarest(classes: DataFrame, members: DataFrame, df: DataFrame, scope: str, rarest: int) -> DataFrame:
    """(scope, cls, keys): the rarest tokens of each class, in order.

    Of many frequencies the BROADCAST largest are set apart: a class that has enough other tokens needs none of those, so that
    most words are neither shuffled nor sorted. The classes that haven't are asked again, with all of their tokens."""

    def of(sets: DataFrame, df: DataFrame, common: DataFrame | None = None) -> DataFrame:
        terms = sets.select(scope, "cls", F.explode("toks").alias("token"))
        terms = terms if common is None else terms.join(F.broadcast(common), [scope, "token"], "left_anti")
        least = F.slice(F.sort_array(F.collect_list(F.struct("df", "token"))), 1, rarest)["token"]
        return terms.join(df.hint("broadcast" if n <= BROADCAST else "shuffle_hash"), [scope, "token"]).groupBy(scope, "cls").agg(least.alias("keys"))

    n = df.count()
    if n <= BROADCAST:
        return of(classes, df)
    high = df.agg(F.percentile_approx("df", 1 - BROADCAST / n)).first()[0]
    common = df.where(F.col("df") > high).select(scope, "token")
    enough = kept(of(classes, df.where(F.col("df") <= high), common).where(F.size("keys") == rarest), "rarest")
    short = kept(members.select("cls").distinct().join(enough.select("cls"), "cls", "left_anti"), "short")
    return enough.unionByName(of(classes.join(_few(short), "cls", "left_semi"), df))


def rare_token_pairs(docs: DataFrame, id: str, scope: str, tokens: Column, least: float, rarest: int = 3) -> DataFrame:
    """Pairs (a < b) of a scope that share one of their rarest tokens (of two documents at least, of any number at most),
    with the Jaccard of their token sets, rounded, where it is `least` or more.

    Documents with equal token sets are one class, that of its first row. Classes are compared, each pair where it shares its
    first token alone; then members take the place of classes. Both steps go by tiles, so that no token or class meets in
    one task. Texts become tokens once, in a stored table, and token sets travel with those classes alone that share a
    rarest token with another."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // DOCS))
    dealt = docs.where(F.col(scope).isNotNull()).repartition(tasks, id)
    # sort_array, as array_sort compares by an interpreted function; rows without tokens go when all are stored, as the
    # optimiser would make tokens once more to find them before the shuffle
    listed = dealt.select(scope, id, F.monotonically_increasing_id().alias("row"), F.sort_array(F.array_distinct(tokens)).alias("toks"))
    rows = kept(listed.withColumn("md5", F.md5(F.array_join("toks", " ").cast("binary"))), "tokens").where(F.size("toks") > 0)
    members = kept(rows.select(scope, id, "row", F.min("row").over(Window.partitionBy(scope, "md5")).alias("cls")), "classes")
    classes = rows.select(scope, F.col("row").alias("cls"), "toks").join(_few(members.where("row <> cls").select(F.col("row").alias("cls"))), "cls", "left_anti")
    df = kept(rows.select(scope, F.explode("toks").alias("token")).groupBy(scope, "token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    keyed = kept(_rarest(classes, members, df, scope, rarest).withColumn("token", F.explode("keys")), "keys")
    shared = keyed.groupBy(scope, "token").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    meeting = kept(keyed.join(shared, [scope, "token"]), "meeting")
    sets = classes.select("cls", "toks").join(_few(meeting.select("cls").distinct()), "cls", "left_semi")
    left, right = _tiles(meeting.join(sets, "cls").withColumn("_at", F.xxhash64("cls")))
    left, right = left.withColumnsRenamed({"cls": "x", "toks": "tx", "keys": "kx"}), right.withColumnsRenamed({"cls": "y", "toks": "ty", "keys": "ky"})
    both = F.size(F.array_intersect("tx", "ty"))
    jaccard = F.round(both / (F.size("tx") + F.size("ty") - both).cast("double"), 6)
    met = left.join(right, [scope, "token", "_i", "_j"]).where((F.col("x") < F.col("y")) & (F.array_intersect("kx", "ky")[0] == F.col("token")))
    across = met.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least).select(scope, "x", "y", "jaccard")
    return _members(members.select(scope, "cls", id), across, id, scope)


def _members(rows: DataFrame, across: DataFrame, id: str, scope: str) -> DataFrame:
    """Pairs of documents: those of one class, with Jaccard 1, and those of two linked classes."""
    sizes = rows.groupBy(scope, "cls").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"), F.count("*").alias("_n"))
    dealt = rows.join(sizes, [scope, "cls"]).select(scope, "cls", id, F.pmod(F.xxhash64(id), F.col("_tiles")).cast("int").alias("_i"))
    within = sizes.where("_n > 1").select(scope, F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("jaccard"))
    many = lambda side: sizes.select(scope, F.col("cls").alias(side), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_" + side))
    linked = across.unionByName(within).join(many("x"), [scope, "x"]).join(many("y"), [scope, "y"])
    one = dealt.withColumnsRenamed({"cls": "x", "_i": "_x", id: "p"})
    two = dealt.withColumnsRenamed({"cls": "y", "_i": "_y", id: "q"})
    pairs = linked.join(one, [scope, "x", "_x"]).join(two, [scope, "y", "_y"]).where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return pairs.select(scope, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "jaccard")
