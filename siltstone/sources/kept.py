"""A dataset kept by key that a batch changes in part: copy on write, a bucket of keys at a time.

Rows lie in buckets by the hash of their key.  A batch is merged with the buckets that its keys fall in, which are written anew into a
folder of their own; all others stay as the files they are.  What makes up the dataset is listed by a manifest; manifests are numbered, and
the dataset is what the last one lists, so a reader sees a batch whole or not at all.

A merge that is lost before its manifest leaves files that nothing lists: the next one takes its number again and writes elsewhere.
Two writers that race for a number: the rename of one of them fails, and it raises.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dataset import key_of, upserted


class KeptDataset:
    """A folder of buckets and manifests; ``buckets`` and ``keys`` are those of the first merge, whatever later ones say."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], *, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        now = self.manifest()
        self.keys, self.buckets = (now["keys"], now["buckets"]) if now else (list(keys), buckets)

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, number: int | None = None) -> dict | None:
        """The last manifest, or the one of a number; None before the first merge."""
        numbers = self._numbers()
        if not numbers:
            return None
        at = self._path(f"{self.folder}/_manifests/{numbers[-1] if number is None else number:012d}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write it beside its place and rename it there, which fails if the number was taken meanwhile."""
        place = self._path(f"{self.folder}/_manifests/{manifest['number']:012d}.json")
        draft = self._path(f"{self.folder}/_manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another merge took number {manifest['number']} of {self.folder}")

    def bucket_of(self, rows: DataFrame) -> Column:
        own = [k for k in self.keys if k in rows.columns]
        if not own:
            raise ValueError(f"none of the keys {self.keys} is a column of the batch")
        return F.pmod(F.xxhash64(key_of(own)), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, number: int | None = None) -> DataFrame | None:
        """The dataset, or some of its buckets, as of the last manifest or an earlier one; None before the first merge."""
        now = self.manifest(number)
        if now is None:
            return None
        paths = [f"{self.folder}/{p}" for b, p in now["parts"].items() if only is None or int(b) in only]
        schema = T.StructType.fromJson(now["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, *, now: str, batch_id: int | None = None) -> dict:
        """Insert or update the rows of ``batch`` (with ``seq``), as :func:`siltstone.plans.dataset.upserted` does; the new manifest.

        A ``batch_id`` that is not above the last one was merged before and changes nothing.  Which buckets are touched comes to
        the driver, as many numbers as there are buckets at most; an empty batch touches none.
        """
        before = self.manifest()
        if before and batch_id is not None and before["batch_id"] is not None and batch_id <= before["batch_id"]:
            return before
        touched = sorted(r[0] for r in batch.select(self.bucket_of(batch)).distinct().collect())
        number = before["number"] + 1 if before else 0
        part = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        if before:
            old = self.read([b for b in touched if str(b) in before["parts"]])
        else:
            old = batch.limit(0).withColumns({"extraction_date": F.lit(""), "last_updated": F.lit("")})
        merged = upserted(old, batch, self.keys, now=now).drop("operation")
        if touched:
            # a bucket's rows come together in one task, or some if it is large
            dealt = merged.withColumn("_bucket", self.bucket_of(merged)).hint("rebalance", F.col("_bucket"))
            dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{part}")
        parts = {**(before["parts"] if before else {}), **{str(b): f"{part}/_bucket={b}" for b in touched}}
        made = {"number": number, "keys": self.keys, "buckets": self.buckets, "batch_id": batch_id if batch_id is not None else (before or {}).get("batch_id"), "parts": parts, "schema": json.loads(merged.schema.json())}
        self._commit(made)
        return made

    def clear(self, *, keep: int = 1) -> list[str]:
        """Delete buckets that none of the last ``keep`` manifests lists, and older manifests; the folders that went."""
        numbers = self._numbers()
        wanted = {p for n in numbers[-keep:] for p in self.manifest(n)["parts"].values()}
        gone = []
        at = self._path(f"{self.folder}/data")
        for version in self._fs.listStatus(at) if numbers and self._fs.exists(at) else []:
            for bucket in self._fs.listStatus(version.getPath()):
                name = f"data/{version.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in wanted:
                    self._fs.delete(bucket.getPath(), True)
                    gone.append(name)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/_manifests/{n:012d}.json"), False)
        return gone
