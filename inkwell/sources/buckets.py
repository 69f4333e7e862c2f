"""Tables in buckets of keys that micro-batches change in place: a batch writes only the buckets it touches.

Data lies in one folder per batch, and a manifest per version names the folder of each bucket. A batch writes its buckets, then
its manifest under another name, and commits by renaming that one file; a reader opens the last manifest and never sees half a
batch. A batch that comes again changes nothing. Folders that no kept version names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions that stay readable, the current one included.
KEPT = 2


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        """keys deal the rows to buckets; the number of buckets must stay what it was when the table was begun."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The versions that are there, from the oldest."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """version, batch, schema and the folder of each bucket; the last version's by default."""
        versions = self.versions()
        if not versions:
            return None
        source = self._fs.open(self._at(f"manifests/{versions[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def read(self, manifest: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets. A table that was never written has no schema: ValueError."""
        manifest = manifest or self.manifest()
        if manifest is None:
            raise ValueError(f"{self.path} holds no version")
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def apply(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """merge(old rows of the touched buckets, new rows) replaces these buckets. Returns whether the batch was new.

        merge must keep rows in the buckets of their keys. What reaches the driver are numbers of buckets.
        """
        old = self.manifest()
        if old is not None and old["batch"] >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.persist()
        try:
            touched = [r[0] for r in rows.select(bucket).distinct().collect()]
            before = self.read(old, touched) if old is not None else rows.limit(0)
            folder = f"{batch:010d}-{uuid.uuid4().hex[:8]}"
            merged = merge(before, rows).select(*rows.columns)
            merged.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        finally:
            rows.unpersist()
        made = {x.getPath().getName().removeprefix("_bucket=") for x in self._fs.listStatus(self._at(f"data/{folder}")) if x.isDirectory()}
        folders = {b: f for b, f in (old or {"folders": {}})["folders"].items() if int(b) not in touched} | {b: folder for b in made}
        version = (old["version"] if old else 0) + 1
        self._commit({"version": version, "batch": batch, "schema": json.loads(rows.schema.json()), "folders": folders})
        self._clean()
        return True

    def _commit(self, manifest: dict) -> None:
        own = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(own)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(own, self._at(f"manifests/{manifest['version']:010d}.json")):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another job")

    def _clean(self) -> None:
        for version in self.versions()[:-KEPT]:
            self._fs.delete(self._at(f"manifests/{version:010d}.json"), False)
        used = {f for v in self.versions() for f in self.manifest(v)["folders"].values()}
        for x in self._fs.listStatus(self._at("data")):
            if x.getPath().getName() not in used:
                self._fs.delete(x.getPath(), True)
