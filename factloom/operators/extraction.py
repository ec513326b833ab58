"""Facts from messages: rules over clauses, corrections over whole messages, confirmations of what was asked before.

Messages are normalised, numbered and marked as open to facts once, into a stored table. From there a message is one row up
to its facts: it is cut into clauses, one scan drops the clauses that no rule can match, and all rules are one array of
expressions over a clause, made once; a rule's pattern runs only where a clause holds a text that it needs. Nothing but found
facts is shuffled, once, to keep one of each text in a message. A confirmation needs the assistant's message
before it: for that a row without text, with what the message asks for, crosses the shuffle by conversation.

Null texts give nothing; texts are read whole; repeated rows each give their facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions import rules as r
from factloom.functions.text import comparable, lexical_tokens
from factloom.operators.tables import kept, spread

QUOTES = "“”\"'‘’"
FACT = "content string, kind string, key string, cardinality string, importance double, confidence double, channel string, intent string, temporal string"


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode's compatibility form, by batches; no such built-in function exists."""
    return pc.utf8_normalize(texts, "NFKC")


def one_line(text: Column) -> Column:
    """Compatibility form in one line: control characters and runs of blanks are one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[\x00-\x1f\x7f]+", " "), r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", " "))


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.rlike(p) for p in patterns])


def holds(text: Column, needs: Sequence[str]) -> Column:
    """Whether a text holds one of needs: a plain search, far cheaper than a pattern."""
    return reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in needs])


def is_safe(text: Column) -> Column:
    return (text != "") & ~any_of(text, r.UNSAFE)


def cleaned(value: Column) -> Column:
    """A value without blanks and quotes around it."""
    return F.trim(F.btrim(F.trim(value), F.lit(QUOTES)))


def clauses(text: Column) -> Column:
    """Parts of a normalised message between sentence ends, and between commas before words that begin a new statement."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r.SENTENCE_ENDS, "\n"), r.CLAUSE_COMMA, "\n"), "\n")
    return F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")


def states_something(text: Column) -> Column:
    """False for hypotheses, quotations, examples, denials and pure questions."""
    corrects = text.rlike(r.NAME_CORRECTION) | text.rlike(r.MOVED)
    denied = any_of(text, [*r.NO_FACTS, r.NEGATED_NAME])
    asks = F.forall(clauses(text), lambda c: c.rlike(r.QUESTION))
    return ~(any_of(text, [*r.META, r.REPORTED]) | (~corrects & denied) | asks)


def _fact(content: Column, kind, key, single, importance: float = 0.8, confidence: float = 0.9, channel: str = "rules", intent: str | None = None, temporal: str | None = None) -> Column:
    cardinality = F.when(single if isinstance(single, Column) else F.lit(single), "single").otherwise("multiple")
    values = [content, kind, key, cardinality, importance, confidence, channel, intent, temporal]
    fields = (f.split() for f in FACT.split(", "))
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for v, (n, t) in zip(values, fields, strict=True)))


def by_rule(clause: Column, low: Column, rule: r.Rule) -> Column:
    """What a rule finds in a clause: its value, empty where it doesn't match, and what the fact says around it; null where the
    clause in lower case holds none of the texts that the rule needs."""
    before = [F.regexp_extract(clause, rule.pattern, 1)] if rule.groups > 1 else []
    found = F.struct(
        cleaned(F.regexp_extract(clause, rule.pattern, rule.groups)).alias("value"), F.concat(F.lit(f"{rule.label}：{rule.before}"), *before).alias("before"),
        *(F.lit(v).cast(t).alias(n) for n, t, v in (("after", "string", rule.after), ("kind", "string", rule.kind), ("key", "string", rule.key), ("single", "boolean", rule.single))),
    )
    return F.when(holds(low, rule.needs), found)


def met_rules(clause: Column, low: Column) -> Column:
    """What all rules find in a clause; low: the clause in lower case."""
    return F.filter(F.array(*(by_rule(clause, low, rule) for rule in r.RULES)), lambda f: f.isNotNull() & (f["value"] != "") & ~any_of(f["value"], r.UNSAFE))


def in_clause(clause: Column, met: Column) -> Column:
    """All facts of a clause: those of the rules that met, or, where there are none, what the speaker asks to remember."""
    found = F.transform(met, lambda f: _fact(F.concat(f["before"], f["value"], f["after"]), f["kind"], f["key"], f["single"]))
    asked = F.coalesce(*(F.nullif(F.regexp_extract(clause, p, 1), F.lit("")) for p in r.REMEMBER))
    asked = F.coalesce(cleaned(asked), F.lit(""))
    explicit = _fact(F.concat(F.lit("用户明确希望记住："), asked), "explicit", None, False, 0.95)
    return F.when(F.size(met) > 0, found).when(is_safe(asked), F.array(explicit))


def in_message(text: Column) -> Column:
    """Facts that a correction, a move or a plain statement of work gives, over clauses."""

    def part(pattern: str, needs: str, group: int = 1) -> Column:
        return F.when(F.contains(text, F.lit(needs)), cleaned(F.regexp_extract(text, pattern, group))).otherwise("")

    name, settled, work, before, now = part(r.NAME_CORRECTION, "不是"), part(r.SETTLED, "搬"), part(r.IN_WORK, "职业方面"), part(r.MOVED, "住"), part(r.MOVED, "住", 2)
    moved = (before != "") & (now != "")
    said = lambda label, value: F.concat(F.lit(f"{label}："), value)
    return F.filter(
        F.array(
            F.when(name != "", _fact(said("用户姓名/名字", name), "identity", "profile.name", True, 0.9, 0.95, intent="correction")),
            F.when(settled != "", _fact(said("用户所在地", settled), "identity", "profile.location", True, 0.9, 0.95, intent="correction")),
            F.when(work != "", _fact(said("用户职业", work), "identity", "profile.occupation", True, 0.9, 0.95)),
            F.when(moved, _fact(said("用户所在地", before), "identity", "profile.location", True, 0.8, 0.9, intent="historical", temporal="historical")),
            F.when(moved, _fact(said("用户所在地", now), "identity", "profile.location", True, 0.9, 0.95, intent="correction", temporal="current")),
        ),
        lambda f: f.isNotNull(),
    )


def confirmed(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, said, fact): a preference that the assistant's last message before asks for, where the user says yes."""
    asked = F.coalesce(*(F.nullif(F.regexp_extract("said", p, 1), F.lit("")) for p in r.ASKED_PREFERENCE), F.lit(""))
    rows = messages.where((F.col("role") == "assistant") | ((F.col("role") == "user") & F.col("said").rlike(r.YES)))
    rows = rows.select("conv", "turn", "row", "role", F.when(F.col("role") == "user", F.col("said")).alias("said"), F.when(F.col("role") == "assistant", cleaned(asked)).alias("asked"))
    before = Window.partitionBy("conv").orderBy("turn", "row").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("asked", F.last(F.when(F.col("role") == "assistant", F.col("asked")), ignorenulls=True).over(before)).where(F.col("role") == "user")
    fact = _fact(F.concat(F.lit("用户喜好/偏好："), F.col("asked")), "preference", None, False, 0.8, 0.82, "context-confirmation")
    return met.where((F.col("asked") != "") & ~any_of(F.col("asked"), r.UNSAFE)).select("conv", "turn", "row", "said", fact.alias("fact"))


def candidates(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, row, place, said, content, kind, key, ...): the facts of each user message, numbered as they stand; of facts
    with one text, whatever its case, the first place and the last properties. row tells repeated rows apart."""
    rows = spread(messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("role IN ('user', 'assistant')"))
    # a stored table, as row numbers, normal forms and whether a message is open to facts are made once and read by every branch
    rows = rows.select("conv", "turn", F.monotonically_increasing_id().alias("row"), "role", one_line(F.col("text")).alias("said"))
    said = F.col("said")
    lines = kept(rows.withColumn("open", F.when(F.col("role") == "user", is_safe(said) & states_something(said)).otherwise(False)), "lines")
    open_ = lines.where("open").select("conv", "turn", "row", "said")
    found = open_.select("*", F.posexplode(in_message(said)).alias("i", "fact")).select("conv", "turn", "row", "said", F.lit(-1).alias("clause"), "i", "fact")
    parts = open_.select("*", F.posexplode(clauses(said)).alias("clause", "text"))
    parts = parts.where(F.col("text").rlike(r.PRESCAN) & ~any_of(F.col("text"), [r.ASKING, *r.NO_FACTS, *r.PASSING]))
    # columns of their own, each used more than once: the optimiser leaves them apart and makes them once
    parts = parts.withColumn("low", F.lower("text")).withColumn("met", met_rules(F.col("text"), F.col("low")))
    ruled = parts.select("conv", "turn", "row", "said", "clause", F.posexplode(in_clause(F.col("text"), F.col("met"))).alias("i", "fact"))
    agreed = confirmed(lines).select("conv", "turn", "row", "said", F.lit(2**31 - 1).alias("clause"), F.lit(0).alias("i"), "fact")
    # by row alone, which both the facts of one text and their places are dealt by
    rows = found.unionByName(ruled).unionByName(agreed).where(is_safe(F.col("fact.content"))).repartition("row")
    order = F.struct("clause", "i")
    single = rows.groupBy("row", F.lower("fact.content").alias("_same")).agg(
        F.first("conv").alias("conv"), F.first("turn").alias("turn"), F.first("said").alias("said"), F.min(order).alias("first"), F.max_by("fact", order).alias("fact")
    )
    at = F.row_number().over(Window.partitionBy("row").orderBy("first"))
    private = any_of(F.col("fact.content"), r.PRIVATE)
    return single.select(
        "conv", "turn", "row", (at - 1).alias("place"), "said", "fact.*",
        F.when(private, "private").otherwise("normal").alias("sensitivity"), F.when(private, "local-only").otherwise("allow-remote").alias("share"),
    )


def _pick(column: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in table.items()), column)


def normalised(rows: DataFrame) -> DataFrame:
    """candidates with predicate, value, polarity, modality, condition, cardinality and aliases; the content itself stays."""
    content, said = F.col("content"), F.coalesce("said", F.lit(""))
    predicate = _pick(F.lower(F.coalesce(F.nullif(F.trim("key"), F.lit("")), F.nullif(F.trim("kind"), F.lit("")), F.lit("memory.fact"))), r.PREDICATES)
    raw = F.trim(F.regexp_replace(content, "^[^:：]{1,80}[:：]\\s*", ""))
    plain = F.trim(F.regexp_replace(F.btrim(raw, F.lit(QUOTES)), r"\s+", " "))
    plain = F.when(F.col("predicate") == "profile.location", F.regexp_replace(plain, "(?:市|城区)$", "")).otherwise(plain)
    plain = F.when(F.col("predicate") == "profile.programming_language", F.coalesce(*(F.when(F.lower(plain) == k, F.lit(v)) for k, v in r.LANGUAGES.items()), plain)).otherwise(plain)
    value = F.trim(F.regexp_replace(F.lower(plain), "[，。！？,.!?]+$", ""))
    held = F.when(said.rlike(r.HYPOTHETICAL), "hypothetical").when(said.rlike(r.SAID), "reported").when(content.rlike(r.PLANNED), "planned").otherwise("asserted")
    # every condition holds this character; without it the pattern would try each place of a text in vain
    when = F.when(F.contains(said, F.lit("时")), F.nullif(F.trim(F.coalesce(*(F.nullif(F.regexp_extract(said, r.CONDITION, g), F.lit("")) for g in (1, 2)))), F.lit("")))
    aliases = F.array_distinct(F.filter(F.array(F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))), F.col("value")), lambda a: a != ""))
    rows = rows.withColumn("predicate", predicate)
    return rows.withColumns(
        {
            "value": value,
            "key": F.when(F.col("key").isNotNull() & (F.col("predicate") != "memory.fact"), F.col("predicate")),
            "polarity": F.when(content.rlike(r.NEGATIVE), "negative").when(content.rlike(r.POSITIVE), "positive").otherwise("unknown"),
            "modality": held,
            "condition": when,
            "cardinality": F.when(F.col("predicate").isin(*r.SINGLE), "single").when(F.col("predicate").isin(*r.SETS), "set").when(F.col("cardinality").isin("single", "set"), F.col("cardinality")).otherwise("multiple"),
        }
    ).withColumn("aliases", aliases)


def fact_value(content: Column) -> Column:
    """What stands behind the last colon of a fact's text, or behind a word of liking, name, place or work, or the text."""
    colon = F.regexp_extract(content, "(?s)^.*[：:](.*)$", 1)
    worded = F.trim(F.regexp_extract(content, r.FACT_WORDS, 1))
    return F.when(content.rlike("[：:]"), F.trim(colon)).when(worded != "", worded).otherwise(content)


def fact_polarity(content: Column) -> Column:
    """-1 for dislikes, 1 for likes, else 0."""
    return F.when(content.rlike(r.DISLIKED), -1).when(content.rlike(r.LIKED), 1).otherwise(0)


def candidate_value(content: Column) -> Column:
    """What stands behind the first colon, or the text without the words that lead in a fact."""
    content = F.trim(content)
    bare = F.trim(F.regexp_replace(F.regexp_replace(content, r.LEADS[0], ""), r.LEADS[1], ""))
    return F.when(content.rlike("[：:]"), F.trim(F.regexp_extract(content, "(?s)^[^：:]*[：:](.*)$", 1))).otherwise(bare)


def _score(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def _value_tokens(text: Column) -> Column:
    """Distinct words, and pairs of Han characters, or the character where there is one alone."""
    tokens = F.array_distinct(lexical_tokens(text))
    han = F.length(F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", ""))
    return F.filter(tokens, lambda t: ~F.startswith(t, F.lit("c:")) | (han == 1))


def scored(rows: DataFrame, expires_in_days: Column | None = None) -> DataFrame:
    """normalised candidates with evidence, durability and verification scores and the reasons for doubt. Columns `doubts`:
    not asserted by the speaker (each with its kind), vague values, single values without a key."""
    said, content = F.col("said"), F.col("content")
    source, value = comparable(said), comparable(candidate_value(content))
    held, there = _value_tokens(value), _value_tokens(source)
    overlap = F.size(F.array_intersect(held, there)) / F.size(held)
    evidence = (
        F.when((F.col("channel") == "context-confirmation") & said.rlike(r.YES), 0.92)
        .when(F.col("channel").isin("rules", "rules+model"), 0.98)
        .when((source == "") | (value == ""), 0.0)
        .when(F.contains(source, value), 1.0)
        .when(F.size(held) == 0, 0.0)
        .otherwise(_score(F.least(F.lit(0.85), 0.15 + 0.7 * overlap)))
    )
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in r.DURABILITY.items()), F.lit(r.DURABILITY["other"]))
    passing = any_of(said, r.TRANSIENT) & ~F.col("kind").isin("project", "goal")
    durable = F.coalesce("importance", F.lit(0.6)) * 0.55 + weight * 0.45 - F.when(passing, 0.45).otherwise(0.0)
    if expires_in_days is not None:
        durable = durable - F.when(expires_in_days <= 1, 0.35).when(expires_in_days <= 7, 0.2).otherwise(0.0)
    named = F.trim(candidate_value(content))
    doubts = [F.when(said.rlike(p), F.lit(f"non-asserted:{k}")) for k, p in r.NOT_ASSERTED.items()]
    doubts += [F.when((named == "") | named.rlike(r.VAGUE), F.lit("ambiguous-value")), F.when((F.col("cardinality") == "single") & F.col("key").isNull(), F.lit("single-value-without-stable-key"))]
    doubts += [F.when(F.col("sensitivity") == "secret", F.lit("automatic-secret"))]
    rows = rows.withColumns({"evidence": evidence, "durable": _score(durable), "doubts": F.filter(F.array(*doubts), lambda d: d.isNotNull())})
    clear = F.greatest(F.lit(0.0), 1 - F.size("doubts") * 0.25)
    return rows.withColumn("verified", _score(F.coalesce("confidence", F.lit(0.7)) * 0.25 + F.col("evidence") * 0.45 + F.col("durable") * 0.2 + clear * 0.1))


# The least scores of a decision, and predicates that a person has to confirm.
LEAST_EXTRACTION, LEAST_EVIDENCE, LEAST_DURABLE, LEAST_VERIFIED = 0.55, 0.62, 0.45, 0.72
REVIEWED = r"^(?:profile\.(?:phone|email|vehicle_plate)|health\.|contact\.)"


def decided(rows: DataFrame, known: DataFrame) -> DataFrame:
    """scored candidates with action, status and reason against known facts (owner, fact_id, key, content, status, updated_at,
    sources array). A candidate (owner, message) meets the facts of its owner with its text and with its key: both sides are
    first put together by (owner, text) and (owner, key), so that a join has one row for each.

    The first that applies: unsafe, not asserted, not durable, unsupported or vague, to be confirmed by a person, suppressed
    before, the same fact (new evidence or a repeat), another value of the key (history, refinement, correction or conflict),
    new. Only the key's facts that are active count; ties go to the newest, then the smallest fact_id."""
    same = known.groupBy("owner", F.lower("content").alias("_text")).agg(F.max_by(F.struct("fact_id", "status", "sources", "key"), F.struct("updated_at", -F.col("fact_id"))).alias("exact"))
    fact = F.struct("updated_at", (-F.col("fact_id")).alias("down"), "fact_id", comparable(candidate_value(F.col("content"))).alias("value"), "sources")
    by_key = known.where((F.col("status") == "active") & F.col("key").isNotNull()).groupBy("owner", F.col("key").alias("_key")).agg(F.reverse(F.array_sort(F.collect_list(fact))).alias("active"))
    met = rows.withColumns({"_text": F.lower("content"), "_key": F.col("key")}).join(same, ["owner", "_text"], "left").join(by_key, ["owner", "_key"], "left")
    active = F.coalesce("active", F.array().cast(by_key.schema["active"].dataType))
    own = comparable(candidate_value(F.col("content")))
    others = F.filter(active, lambda f: ~f["fact_id"].eqNullSafe(F.col("exact.fact_id")))
    same_value = F.get(F.filter(active, lambda f: f["value"] == own), F.lit(0))

    def refines(f: Column) -> Column:
        low, high = F.least(F.length(f["value"]), F.length(own)), F.greatest(F.length(f["value"]), F.length(own))
        held = F.when(F.length(own) <= F.length(f["value"]), F.contains(f["value"], own)).otherwise(F.contains(own, f["value"]))
        return (f["value"] != own) & (low >= 2) & held & (high - low <= F.greatest(F.lit(6), low))

    refined = F.get(F.filter(active, refines), F.lit(0))
    new = lambda sources: ~F.array_contains(sources, F.col("message"))
    corrects = F.coalesce(F.col("intent").isin("correction", "supersede"), F.lit(False)) | any_of(F.col("said"), r.CORRECTIONS)
    history = F.coalesce((F.col("temporal") == "historical") | (F.col("intent") == "historical"), F.lit(False))
    doubt = lambda name: F.array_contains("doubts", name)
    unproved = (F.coalesce("confidence", F.lit(0.7)) < LEAST_EXTRACTION) | (F.col("evidence") < LEAST_EVIDENCE) | (F.col("verified") < LEAST_VERIFIED) | doubt("ambiguous-value") | doubt("automatic-secret")
    active_exact = F.coalesce(F.col("exact.status") == "active", F.lit(False))

    def step(action: str, status: str, reason: str, matched: Column | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), (matched if matched is not None else F.lit(None)).cast("bigint").alias("matched_id"))

    exact_id = F.col("exact.fact_id")
    act = (
        F.when(~is_safe(F.col("content")), step("NOOP", "rejected", "unsafe-content"))
        .when(F.exists("doubts", lambda d: F.startswith(d, F.lit("non-asserted:"))), step("NOOP", "rejected", "not-a-user-assertion"))
        .when(F.col("durable") < LEAST_DURABLE, step("NOOP", "rejected", "insufficient-durability"))
        .when(unproved, step("QUARANTINE", "quarantined", "policy-quarantine"))
        .when(F.col("predicate").rlike(REVIEWED) | (F.col("sensitivity") == "secret"), step("QUARANTINE", "quarantined", "high-risk-field-requires-confirmation"))
        .when(F.col("exact.status").isin("suppressed", "deleted"), step("NOOP", "rejected", "user-lifecycle-state-protected", exact_id))
        .when(active_exact & (F.size(others) == 0) & new(F.col("exact.sources")), step("MERGE_EVIDENCE", "accepted", "matching-fact-new-evidence", exact_id))
        .when(active_exact & (F.size(others) == 0), step("NOOP", "accepted", "idempotent-repeat", exact_id))
        .when(same_value.isNotNull() & new(same_value["sources"]), step("MERGE_EVIDENCE", "accepted", "matching-key-new-evidence", same_value["fact_id"]))
        .when(same_value.isNotNull(), step("NOOP", "accepted", "idempotent-repeat", same_value["fact_id"]))
        .when((F.size(active) > 0) & history, step("ADD", "accepted", "historical-version-preserved"))
        .when(refined.isNotNull() & (F.col("confidence") >= 0.8) & (F.col("evidence") >= 0.85), step("REFINE", "accepted", "supported-refinement", refined["fact_id"]))
        .when((F.size(active) > 0) & corrects, step("SUPERSEDE", "accepted", "explicit-supported-correction", F.get(active, F.lit(0))["fact_id"]))
        .when(F.size(active) > 0, step("CONFLICT", "quarantined", "conflict-requires-confirmation", F.get(active, F.lit(0))["fact_id"]))
        .when(exact_id.isNotNull(), step("ADD", "accepted", "inactive-fact-reasserted", exact_id))
        .otherwise(step("ADD", "accepted", "new-supported-fact"))
    )
    return met.withColumn("_act", act).select(*rows.columns, "_act.*")
