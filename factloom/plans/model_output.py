"""Queries on nested model output, made of the words of every document: some payloads are broken, some entries say what the text
doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import model_output
from factloom.plans import views


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first Latin word is a person, twice with different scores, and as a school with one sign too many; the second is where
    the person lives, or, for every third document, when it was founded."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, word = F.col("doc_id"), "[^A-Za-z]*+([A-Za-z]*+)"
    docs = docs.withColumns({"a": F.regexp_extract("text", f"^{word}", 1), "b": F.regexp_extract("text", f"^{word}{word}", 2)})
    docs = docs.withColumn("a_at", F.instr("text", F.col("a")) - 1)
    docs = docs.withColumn("b_at", F.col("a_at") + F.length("a") + F.instr(F.substr("text", F.col("a_at") + F.length("a") + 1), F.col("b")) - 1)

    def entry(word: str, at: str, score, longer: int = 0):
        text = F.when(k % 11 == 0, F.concat(F.col(word), F.lit("??"))).otherwise(F.col(word))
        return [text.alias("text"), F.col(at).alias("start"), (F.col(at) + F.length(word) + longer).alias("end"), score.alias("probability")]

    place = F.to_json(F.array(F.struct(*entry("b", "b_at", F.lit(0.5)))))
    when = F.to_json(F.struct(*entry("a", "a_at", (k % 10) / 10.0)))
    lives = F.concat(F.expr("substring(" + "j, 1, length(j) - 1)"), F.lit(', "relations": {"'), F.when(k % 3 == 0, "成立日期").otherwise("居住地"), F.lit('": '), F.col("o"), F.lit(', "": [], "odd": 3}}'))
    again = F.to_json(F.struct(*entry("a", "a_at", F.when(k % 13 == 0, 1.5).otherwise(0.3))))
    school = F.to_json(F.struct(*entry("a", "a_at", F.lit(0.9), 1)))
    docs = docs.withColumns({"j": when, "o": place}).withColumns({"person": lives, "again": again, "school": school})
    whole = F.concat(F.lit('{"人物": ['), "person", F.lit(", "), "again", F.lit(', 7, null], "学校": ['), "school", F.lit('], "unknown": {}, "姓名": ['), "again", F.lit("]}"))
    payload = F.when(k % 17 == 0, F.lit('{"人物": [')).when(k % 19 == 0, F.lit("[1]")).otherwise(whole)
    return docs.select("doc_id", "text", payload.alias("payload"))


def output_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output.mentions(_payloads(spark, sf_dir), "doc_id", "text", "payload")


def output_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_output.rejects(_payloads(spark, sf_dir), "doc_id", "payload")


def extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the runs that the payloads become."""
    rows = _payloads(spark, sf_dir)
    found = model_output.relations(rows, "doc_id", "text", "payload")
    return model_output.run_facts(found, rows, "doc_id", "text")


def extraction_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of the runs, one of each span."""
    rows = _payloads(spark, sf_dir)
    return model_output.run_entities(model_output.mentions(rows, "doc_id", "text", "payload"), model_output.relations(rows, "doc_id", "text", "payload"), "doc_id")


_BASE = """w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ws FROM documents),
p AS (SELECT doc_id, t, coalesce(ws[1], '') AS a, coalesce(ws[2], '') AS b FROM w), q AS (SELECT *, strpos(t, a) - 1 AS a_at FROM p),
v AS (SELECT *, a_at + length(a) + strpos(substring(t, a_at + length(a) + 1), b) - 1 AS b_at, (doc_id % 10) / 10.0 AS s, doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 11 <> 0 AND a <> '' AS fine FROM q)"""
OUTPUT_MENTIONS = f"""WITH {_BASE}
SELECT doc_id, '人物' AS label, 'entity' AS role, a AS text, a_at AS start, a_at + length(a) AS "end", CAST(CASE WHEN doc_id % 13 = 0 THEN s ELSE greatest(s, 0.3) END AS DOUBLE) AS score FROM v WHERE fine
UNION ALL SELECT doc_id, '姓名', 'field', a, a_at, a_at + length(a), 0.3 FROM v WHERE fine AND doc_id % 13 <> 0"""
OUTPUT_REJECTS = """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'malformed' ELSE 'not-an-object' END AS reason FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0"""
EXTRACTION_RUN = f"""WITH {_BASE}, u AS (SELECT *, length(substring(t, 1, a_at)) + len(list_filter(string_split(substring(t, 1, a_at), ''), lambda c: unicode(c) > 65535)) AS lo, length(substring(t, 1, b_at + length(b))) + len(list_filter(string_split(substring(t, 1, b_at + length(b)), ''), lambda c: unicode(c) > 65535)) AS hi FROM v WHERE fine AND b <> '')
SELECT doc_id, a_at || ':' || (a_at + length(a)) AS subject, CASE WHEN doc_id % 3 = 0 THEN '成立日期' ELSE '居住地' END AS predicate, CASE WHEN doc_id % 3 <> 0 THEN b_at || ':' || (b_at + length(b)) END AS object, CASE WHEN doc_id % 3 = 0 THEN b END AS literal,
  CASE WHEN doc_id % 3 = 0 THEN 'date' END AS value_type, lo AS start, hi AS "end", CAST(least(s, 0.5) AS DOUBLE) AS score FROM u"""
EXTRACTION_ENTITIES = f"""WITH {_BASE}, e AS (SELECT doc_id, a_at AS start, a_at + length(a) AS "end", 'person' AS type, a AS text, CAST(CASE WHEN doc_id % 13 = 0 THEN s ELSE greatest(s, 0.3) END AS DOUBLE) AS score FROM v WHERE fine)
SELECT * FROM e UNION ALL SELECT doc_id, b_at, b_at + length(b), 'location', b, 0.5 FROM v WHERE fine AND b <> '' AND doc_id % 3 <> 0"""

QUERIES = {f.__name__: f for f in (output_mentions, output_rejects, extraction_run, extraction_entities)}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
