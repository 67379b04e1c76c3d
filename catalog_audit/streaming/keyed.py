"""A table of one row per key in hash buckets, changed batch by batch.

A batch reads and rewrites the buckets that its keys fall into and no others; a manifest then names the current
folder of every bucket, and the rename that puts the manifest in place is the commit. A batch that is replayed finds its
number committed and changes nothing; one that failed halfway left folders that no manifest names and that its retry
overwrites. Reading costs the latest state, whatever the history. The number of buckets is fixed with the first
commit: choose it so that a bucket is some hundred megabytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T


class KeyedTable:
    """``combine`` turns the current rows of some buckets together with a batch of changes into their new rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], combine: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.combine, self.buckets = spark, path.rstrip("/"), schema, keys, combine, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{self.path}/{name}")
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, batch: int) -> dict:
        lines = self.spark.read.text(f"{self.path}/manifest/{batch:012d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def state(self) -> dict:
        """The latest manifest: ``batch``, ``buckets`` (number, folder of each), ``notes``."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"batch": -1, "count": self.buckets, "buckets": {}, "notes": {}}

    def _commit(self, manifest: dict) -> None:
        self._fs.mkdirs(self._at("manifest"))
        name = f"manifest/{manifest['batch']:012d}"
        out = self._fs.create(self._at(f"{name}.tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.rename(self._at(f"{name}.tmp"), self._at(f"{name}.json"))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]).drop("bucket")

    def merge(self, changes: DataFrame, batch: int, notes: dict | None = None) -> bool:
        """Apply one batch; False if it is committed already. ``notes`` are kept with the manifest."""
        now = self.state()
        if batch <= now["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(now["count"])).cast("int").alias("bucket")
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # at most the number of buckets
        if touched:
            current = self._rows([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]])
            new = self.combine(current.unionByName(changes.select(*current.columns))).select("*", bucket)
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch:012d}")
        places = now["buckets"] | {str(b): f"data/{batch:012d}/bucket={b}" for b in touched}
        self._commit({"batch": batch, "count": now["count"], "buckets": places, "notes": now["notes"] | (notes or {})})
        return True

    def read(self) -> DataFrame:
        return self._rows(sorted(self.state()["buckets"].values()))

    def vacuum(self, keep: int = 2) -> int:
        """Delete bucket folders that none of the last ``keep`` manifests names, and older manifests."""
        versions, gone = self._versions(), 0
        named = {f for v in versions[-keep:] for f in self._manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            for folder in set(self._manifest(v)["buckets"].values()) - named:
                gone += bool(self._fs.delete(self._at(folder), True))
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"manifest/{v:012d}.json"), False)
        return gone
