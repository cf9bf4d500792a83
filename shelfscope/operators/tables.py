"""Merged tables in hash buckets of their key: a merge reads and writes the buckets that its rows fall into, no others.

A version is a manifest that names the folder of every bucket; folders are never changed. A merge writes new folders for the
touched buckets, then a manifest that shares all other folders with the version before. The manifest appears by one rename,
so readers see whole versions only, and a writer that dies leaves folders that nobody names. A manifest also notes the last
batch of each stream that it holds, by which a batch that comes again is told.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Table:
    """A bucketed table at root. Buckets should hold what a task can sort: rows / buckets * row size of about 1 GB at most."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no version in {self.root}")
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"manifests/v{version:09d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def _publish(self, manifest: dict, version: int) -> int:
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(part)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        whole = self._path(f"manifests/v{version:09d}.json")
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            raise RuntimeError(f"version {version} of {self.root} was written by somebody else")
        return version

    def _write(self, rows: DataFrame, manifest: dict) -> dict[str, str]:
        """Writes rows to new folders; bucket -> folder."""
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumn("__bucket", bucket(rows, manifest["keys"], manifest["buckets"]))
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{name}")
        folders = [x.getPath().getName() for x in self._fs.listStatus(self._path(name)) if x.isDirectory()]
        return {f.split("=")[1]: f"{name}/{f}" for f in folders if f.startswith("__bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 256) -> int:
        manifest = {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "streams": {}}
        return self._publish(manifest | {"folders": self._write(rows, manifest)}, max(self.versions(), default=0) + 1)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version (the last one), or some of its buckets."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        names = sorted(m["folders"]) if buckets is None else [str(b) for b in buckets if str(b) in m["folders"]]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{m['folders'][b]}" for b in names))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall into: at most as many numbers as there are buckets."""
        m = self.manifest()
        return sorted(r[0] for r in rows.select(bucket(rows, m["keys"], m["buckets"]).alias("b")).distinct().collect())

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None) -> int:
        """The version after merging rows by how(old, rows). `how` must leave rows in the bucket of their key. A batch number
        that the stream has merged before changes nothing, so batches can be run again."""
        m = self.manifest()
        if stream is not None and m["streams"].get(stream, -1) >= batch:
            return m["version"]
        some = self.touched(rows)
        streams = m["streams"] | ({stream: batch} if stream is not None else {})
        folders = self._write(how(self.read(m["version"], some), rows), m) if some else {}
        kept = {b: f for b, f in m["folders"].items() if int(b) not in set(some)}
        return self._publish({k: v for k, v in m.items() if k != "version"} | {"streams": streams, "folders": kept | folders}, m["version"] + 1)


def bucket(rows: DataFrame, keys: list[str], buckets: int) -> Column:
    """Bucket of a row by its key as text; rows without a whole key are spread by all their columns."""
    by_key = F.xxhash64(*(F.col(k).cast("string") for k in keys))
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    return F.pmod(F.when(whole, by_key).otherwise(F.xxhash64(*(F.to_json(F.struct("*")),))), F.lit(buckets)).cast("int")
