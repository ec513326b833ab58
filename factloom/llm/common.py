"""What the operators of this package share: tables, scratch tables in the shared folder, text slices for Arrow tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task holds as Python objects; a longer text is a step of its own.
STEP_CHARS = 1_000_000
#: Bytes of an Arrow batch on its way to Python, rows of a batch that a scan holds, and bytes of a row group that a
#: writing task holds: texts differ much in length.
BATCH_BYTES, SCAN_ROWS, ROW_GROUP = 4_000_000, 512, 16_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's batches; smaller bounds of its own stay. A longer text is a batch of its own."""
    for name, most, unit in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b"), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS, "")):
        held = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if held and int(held[1]) > most:
            spark.conf.set(name, f"{most}{unit}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a
    folder of its own; a cluster without the setting is refused, as its executors would not see the files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, stored in a folder of its own. cleared() stores a result apart and deletes that folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.root = spark, label, scratch_path(spark, label)
        self.tables, self.names = 0, []

    def stored(self, df: DataFrame) -> DataFrame:
        bounded_batches(self.spark)
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """df stored in buckets by key, so that joins on it move the other side alone; a table of the session's catalogue
        until cleared()."""
        bounded_batches(self.spark)
        name, buckets = f"factloom_{uuid.uuid4().hex}", min(buckets, 20_000)
        rows = df.repartition(buckets, key).write.option("parquet.block.size", ROW_GROUP).option("path", f"{self.root}/{name}")
        rows.format("parquet").bucketBy(buckets, key).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def cleared(self, df: DataFrame) -> DataFrame:
        result = stored(df, self.label)
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return result


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], each: int, how: str = "left") -> DataFrame:
    """rows joined with facts (keys, n, ...), which has one row for each key, with n, how many of the rows have it. A key
    with more than `each` rows is met in n / each places. What is broadcast for that are those keys alone: one for each
    `each` rows of the input at most."""
    fan, place = fresh(rows, "fan"), fresh(rows, "place")
    hot = F.broadcast(facts.where(F.col("n") > each).select(*keys, F.ceil(F.col("n") / each).cast("int").alias(fan)))
    dealt = rows.join(hot, keys, "left").withColumn(place, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(fan, F.lit(1))).cast("int")).drop(fan)
    copies = facts.withColumn(place, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("n") / each)).cast("int") - 1))).drop("n")
    return dealt.join(copies, [*keys, place], how).drop(place)


def text_runs(texts: pa.Array, most: int = STEP_CHARS) -> Iterator[list[str]]:
    """The texts of an Arrow array in order, nulls as empty, in lists of at most `most` characters, or one longer text:
    Python objects exist for one list at a time."""
    held, size = [], 0
    for at in range(0, len(texts), 128):
        for text in texts.slice(at, 128).to_pylist():
            text = text or ""
            if held and size + len(text) > most:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield held


def held_out(key: Column | str) -> Column:
    """True for keys whose CRC-32, as text, leaves remainder 0 modulo 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit("")).cast("binary")) % 5 == 0


def shards(rows: int, each: int, least: int = 1) -> int:
    """How many groups keep about `each` of `rows` rows."""
    return max(least, -(-rows // each))


# Bytes of UTF-8 texts that separate words become spaces, A-Z become a-z; all bytes from 0x80 on belong to words.
_WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


class Remembered(dict):
    """What `make` gives for a key, kept for up to `most` keys; beyond that, keys are made anew each time."""

    def __init__(self, make, most: int = 60_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def mix64(x):
    """A 64-bit finaliser over a numpy array of unsigned integers: each bit of the input reaches all of the output."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
