"""Nested output of extraction models, flattened: labels hold mentions, mentions hold relations, and nothing has to be there.

Payloads are read as VARIANT values, since their labels are data: objects become maps, their entries arrays, and an entry
counts only if it has the types, a score from 0 to 1, and a span of code points where the source says just its text. Of
mentions with one label and span, and of relations with one pair of spans and predicate, the best score stays. Payloads
that are no JSON, or no object, are rejects with a reason; entries that don't count are left out, as in a partial answer.

Ties go to the smaller label. A null payload is a reject; a null source has no spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.literals import utf16_offset

# Labels of entities and of fields of the speaker, types of labels, and predicates whose objects are literals.
ENTITIES = ("人物", "地点", "组织机构", "项目", "企业", "影视作品", "图书作品", "歌曲", "历史人物", "学校", "国家", "行政区", "机构")
FIELDS = ("姓名", "职业", "所在地", "喜好", "当前项目")
TYPES = {
    "person": ("人物", "历史人物", "父亲", "母亲", "丈夫", "妻子", "主演", "导演", "作者", "歌手", "作词", "作曲", "董事长", "创始人", "校长"),
    "organization": ("组织机构", "机构", "企业", "学校", "所属组织", "毕业院校", "出品公司"),
    "location": ("地点", "国家", "行政区", "总部地点", "国籍", "居住地"),
    "film": ("影视作品",), "book": ("图书作品",), "song": ("歌曲", "主题曲", "所属专辑"),
}
LITERALS = {"date": ("上映时间", "成立日期"), "number": ("票房", "人口数量"), "string": ("官方语言", "朝代")}


def _of(table: dict[str, tuple[str, ...]], label: Column) -> Column:
    return F.coalesce(*(F.when(label.isin(*labels), F.lit(k)) for k, labels in table.items()))


def entity_type(label: Column) -> Column:
    return F.coalesce(_of(TYPES, label), label)


def rejects(rows: DataFrame, id: str, payload: str) -> DataFrame:
    """(id, reason) of payloads that can't be read."""
    held = rows.select(id, F.try_parse_json(F.col(payload)).alias("v"))
    reason = F.when(F.col("v").isNull(), "malformed").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not-an-object")
    # exploded, not filtered: a filter moves below all that a payload is made of, with a copy of each expression for each use of it
    return held.select(id, F.explode(F.array_compact(F.array(reason))).alias("reason"))


def _map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _mention(entry: Column, source: Column) -> Column:
    """(text, start, end, score) of an entry, or null."""
    kind = lambda name: F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))
    number = lambda name: F.try_variant_get(entry, f"$.{name}", "double")
    text, start, end, score = F.try_variant_get(entry, "$.text", "string"), number("start"), number("end"), number("probability")
    typed = (kind("text") == "STRING") & kind("start").rlike("^(BIGINT|DOUBLE|DECIMAL)") & kind("end").rlike("^(BIGINT|DOUBLE|DECIMAL)") & kind("probability").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    whole = (start == F.floor(start)) & (end == F.floor(end)) & (start >= 0) & (end > start) & (end <= F.length(source))
    said = F.substr(source, start.cast("int") + 1, (end - start).cast("int")) == text
    value = F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("score"))
    return F.when(F.coalesce(typed & whole & score.between(0, 1) & said, F.lit(False)), value)


def _subjects(rows: DataFrame, id: str, source: str, payload: str) -> DataFrame:
    held = rows.select(id, F.col(source).alias("source"), F.try_parse_json(F.col(payload)).alias("v"))
    labels = held.select(id, "source", F.explode(_map(F.col("v"))).alias("label", "entries"))
    entries = labels.select(id, "source", "label", F.explode(_array(F.col("entries"))).alias("entry"))
    return entries.withColumn("m", _mention(F.col("entry"), F.col("source"))).where("m IS NOT NULL")


def mentions(rows: DataFrame, id: str, source: str, payload: str) -> DataFrame:
    """(id, label, role, text, start, end, score): entity and field mentions, the best of each label and span."""
    found = _subjects(rows, id, source, payload).select(id, "label", "m.*")
    role = F.when(F.col("label").isin(*ENTITIES), "entity").when(F.col("label").isin(*FIELDS), "field")
    return found.withColumn("role", role).where("role IS NOT NULL").groupBy(id, "label", "role", "text", "start", "end").agg(F.max("score").alias("score"))


def relations(rows: DataFrame, id: str, source: str, payload: str) -> DataFrame:
    """(id, predicate, subject, object, score): subject and object are (label, text, start, end, score); the score is the smaller of
    both, and of each pair of spans and predicate the best stays."""
    subjects = _subjects(rows, id, source, payload)
    nested = subjects.select(id, "source", "label", "m", F.explode(_map(F.try_variant_get("entry", "$.relations", "variant"))).alias("predicate", "objects")).where("trim(predicate) <> ''")
    each = nested.select(id, "label", "m", "predicate", "source", F.explode(_array(F.col("objects"))).alias("entry")).withColumn("o", _mention(F.col("entry"), F.col("source"))).where("o IS NOT NULL")
    whole = lambda label, m: F.struct(label.alias("label"), *(F.col(f"{m}.{c}").alias(c) for c in ("text", "start", "end", "score")))
    found = each.select(id, "predicate", whole(F.col("label"), "m").alias("subject"), whole(F.col("predicate"), "o").alias("object"), F.least("m.score", "o.score").alias("score"))
    order = Window.partitionBy(id, "predicate", "subject.start", "subject.end", "object.start", "object.end").orderBy(F.desc("score"), "subject.label", F.desc("subject.score"), F.desc("object.score"))
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def run_entities(mentions: DataFrame, relations: DataFrame, id: str) -> DataFrame:
    """(id, start, end, type, text, score): one entity for each span, of mentions and of the ends of relations; a label with a type
    of its own comes before one without, then the smaller label. Offsets are code points."""
    ends = [mentions.select(id, "label", "text", "start", "end", "score"), relations.select(id, "subject.*"), relations.where(_of(LITERALS, F.col("predicate")).isNull()).select(id, "object.*")]
    rows = ends[0].unionByName(ends[1]).unionByName(ends[2]).withColumn("type", entity_type(F.col("label")))
    order = Window.partitionBy(id, "start", "end").orderBy((F.col("type") == F.col("label")), "label", F.desc("score"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select(id, "start", "end", "type", "text", "score")


def run_facts(relations: DataFrame, sources: DataFrame, id: str, source: str) -> DataFrame:
    """(id, subject, predicate, object, literal, value_type, start, end, score): facts of a run. Subject and object name spans, an
    object that its predicate makes a literal is its text; the evidence is the hull of both spans, in UTF-16 units."""
    span = lambda m: F.concat_ws(":", F.col(f"{m}.start"), F.col(f"{m}.end"))
    kind = _of(LITERALS, F.col("predicate"))
    low, high = F.least("subject.start", "object.start"), F.greatest("subject.end", "object.end")
    met = relations.join(sources.select(id, F.col(source).alias("source")), id)
    return met.select(
        id, span("subject").alias("subject"), "predicate", F.when(kind.isNull(), span("object")).alias("object"), F.when(kind.isNotNull(), F.col("object.text")).alias("literal"), kind.alias("value_type"),
        utf16_offset("source", low).alias("start"), utf16_offset("source", high).alias("end"), "score",
    )
