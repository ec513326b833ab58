"""Corpus pipeline over `documents`: every stage works on what the one before it kept.

Quality classifier (documents that it rejects go), near duplicates (one document of each group stays), benchmark
decontamination (the words of every benchmark window are cut out of the texts), secret scan (secrets become a mark), and
best-fit packing (token pieces with their place in sequences). All stages but the last return the columns of documents;
n_chars follows the text. Stages pass on null and empty texts unless the quality classifier rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import stored, table
from factloom.llm.decontamination import remove_phrases, windows_of
from factloom.llm.near_duplicates import drop_near_duplicates
from factloom.llm.packing import pack_documents
from factloom.llm.quality import THRESHOLD, score_quality, train_quality
from factloom.llm.secret_scan import redact_secrets


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, out="_score").where(F.col("_score") >= THRESHOLD).drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_phrases(docs, windows_of(table(spark, sf_dir, "benchmark"))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: The stages learn, sketch and tokenise, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
