"""Tables that take change batches: rows lie in buckets of their key, a batch rewrites the buckets that it touches, and a
manifest, published last, says which folder of each bucket counts.

A change is a row (key, seq, op, ...): `upsert` or `delete`. The change with the highest seq of a key counts, whatever the
order of arrival; of equal ones a deletion, then the one whose other columns are the last as JSON text; deletions stay as marks, so that an older upsert that comes late brings nothing back. Readers follow the
newest published manifest and see whole versions only; a version that was never published is ignored. A batch that a
source sends again, by its name and number, changes nothing.

The driver reads one row of the manifest for each bucket, never rows of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MANIFEST = "bucket int, folder string, source string, batch long, rows long"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "key", seq: str = "seq", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path.rstrip("/"), key, seq, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        missing = {key, seq, "op"} - set(self.schema.names)
        if missing:
            raise ValueError(f"a change needs the columns {sorted(missing)}")

    def _entries(self, *below: str) -> list[str]:
        """Names of the entries of a folder, in any store that Spark can read; none if it isn't there."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []

    def versions(self) -> list[int]:
        """Published versions in order: those whose manifest was written to its end."""
        found = [int(n.partition("=")[2]) for n in self._entries("manifest") if n.startswith("version=")]
        return sorted(v for v in found if "_SUCCESS" in self._entries("manifest", f"version={v}"))

    def manifest(self, version: int | None = None) -> dict[int, dict]:
        """(folder, rows) by bucket, of a published version, or of the newest."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else None
        if version is None:
            return {}
        if version not in known:
            raise ValueError(f"version {version} isn't published")
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").where("bucket IS NOT NULL").collect()
        return {r.bucket: r.asDict() for r in rows}

    def _seen(self) -> dict[str, int]:
        """The last batch of every source, which each manifest carries on in rows without a bucket."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={known[-1]}").where("bucket IS NULL").collect()
        return {r.source: r.batch for r in rows}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(set(folders))))

    def changes(self, version: int | None = None) -> DataFrame:
        """The newest change of every key, deletions included."""
        return self._read([m["folder"] for m in self.manifest(version).values() if m["rows"]])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: what the newest changes leave."""
        return self.changes(version).where("op <> 'delete'").drop("op")

    def merge(self, batch: DataFrame, source: str = "", number: int | None = None) -> bool:
        """Takes a batch of changes; False if this source has sent this batch before, or it is empty. One writer at a time."""
        before = self.manifest()
        seen = self._seen()
        if number is not None and seen.get(source, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.names).where(F.col(self.key).isNotNull()).withColumn("bucket", bucket)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return False
        held = self._read([before[b]["folder"] for b in touched if b in before and before[b]["rows"]]).withColumn("bucket", bucket)
        # of a key the highest seq; a deletion wins a tie, so that a pair of equal age can't depend on arrival
        change = F.struct(*(c for c in self.schema.names if c != self.key))
        order = F.struct(F.col(self.seq), (F.col("op") == "delete").alias("gone"), F.to_json(change).alias("text"))
        newest = held.unionByName(rows).groupBy("bucket", self.key).agg(F.max_by(change, order).alias("c"))
        version = max([-1, *(int(n.partition("=")[2]) for n in self._entries("data")), *self.versions()]) + 1
        out = newest.select("bucket", F.col(self.key), *(F.col(f"c.{c}").alias(c) for c in self.schema.names if c != self.key)).select("bucket", *self.schema.names)
        out.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        sizes = {r.bucket: r.n for r in self.spark.read.parquet(f"{self.path}/data/version={version}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        now = before | {b: {"bucket": b, "folder": f"data/version={version}/bucket={b}", "rows": sizes[b]} for b in touched}
        entries = [(m["bucket"], m["folder"], None, None, m["rows"]) for m in now.values()]
        entries += [(None, None, s, n, None) for s, n in (seen | ({source: number} if number is not None else {})).items()]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")
        return True

    def forget(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest `keep` versions reads; their number."""
        known = self.versions()
        used = {m["folder"] for v in known[-keep:] for m in self.manifest(v).values()}
        store_of = lambda p: p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f"data/{v}/{b}" for v in self._entries("data") for b in self._entries("data", v) if b.startswith("bucket=") and f"data/{v}/{b}" not in used]
        gone += [f"manifest/version={v}" for v in known[:-keep]]
        for name in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            store_of(at).delete(at, True)
        return len(gone)
