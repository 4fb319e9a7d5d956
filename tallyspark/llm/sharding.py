"""Sharding by size-tiered compaction, with versioned manifests.

A store is a folder with data files, manifests and versions. Arrivals are appended as small immutable Parquet shards.
Shards of similar size (the same power of ``fanout``) are one tier; a tier with ``fanout`` shards or more under half the target
size is merged into files of about ``target_bytes``, until no tier has so many. Every change is one version: a manifest (a Parquet table
of shard paths, sizes and row counts) is written first, then a small pointer file is renamed to the version's name, which fails
if that version exists. A reader sees a version whole or not at all; what a failed writer left is in no manifest.

Edge cases: an empty arrival commits a version without new shards. Rows are kept as they are: nulls, repeated rows, empty
and very long texts, columns of any name. All arrivals need one schema; another one is an error. A version that another
writer commits meanwhile makes an append try again on top of it. So does a compaction, as long as the new version still
has the shards that it merged; if another writer has merged one of them, its own files go and it begins anew.

Scale: rows aren't shuffled. Appending is one pass, whatever the number of arrivals in it. Merging lets Spark pack whole small files
into read partitions of the target size, each of which becomes one file; one merge takes at most ``merge_files`` shards, and
merges go on until no tier is full. A read names folders, one for each arrival and merge, not files. Of a folder that has lost
some of its shards to a merge, rows are taken by a semi-join of their file's path with the manifest. So the driver gets a row for
each shard of one merge and for each folder of a read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "path string, bytes long, rows long, version long"


class ShardStore:
    """A versioned store of Parquet shards under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4, least_bytes: int = 1 << 16, merge_files: int = 10_000):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes, self.merge_files = target_bytes, fanout, least_bytes, merge_files
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._fs.FileContext.getFileContext(jvm.java.net.URI(self.root), conf)
        self._system = self._path("").getFileSystem(conf)

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    # versions

    def versions(self) -> list[int]:
        at = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in self._system.listStatus(at) if f.getPath().getName().isdigit()) if self._system.exists(at) else []

    def _pointer(self, version: int | None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "manifest": None, "schema": None, "shards": 0}
        if version not in known:
            raise ValueError(f"no version {version}")
        at = self._system.open(self._path(f"versions/{version:012d}"))
        try:
            return json.loads(bytes(at.readAllBytes()).decode())
        finally:
            at.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, version it was added in) of the shards of a version, the last one if None."""
        name = self._pointer(version)["manifest"]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{name}") if name else self.spark.createDataFrame([], MANIFEST)

    def history(self) -> DataFrame:
        """(version, shards, bytes, rows, small, fullest) of every version: its shards, those under half the target size, and the most of these in one tier."""
        named = [(v, self._pointer(v)["manifest"]) for v in self.versions()]
        if not named:
            return self.spark.createDataFrame([], "version long, shards long, bytes long, rows long, small long, fullest long")
        of = self.spark.createDataFrame([(v, m.rsplit("/", 1)[1]) for v, m in named], "version long, name string")
        listed = self.spark.read.schema(MANIFEST).parquet(*(f"{self.root}/{m}" for _, m in named)).drop("version")
        small = F.when(F.col("bytes") < self.target_bytes // 2, 1)
        tiers = listed.withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -2)).groupBy("name", F.when(small == 1, self._tier()).alias("tier"))
        tiers = tiers.agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(small).alias("small"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return of.join(tiers, "name", "left").groupBy("version").agg(total("shards"), total("bytes"), total("rows"), total("small"), F.coalesce(F.max("small"), F.lit(0)).alias("fullest"))

    def _commit(self, base: dict, added: DataFrame, removed: list[str], schema: str) -> bool:
        """Commits the version after `base`; False if another writer has."""
        version, name = base["version"] + 1, f"manifests/{uuid.uuid4().hex}"
        left = self.manifest(base["version"])
        if removed:
            gone = self.spark.createDataFrame([(p,) for p in removed], "path string")
            left = left.join(gone, "path", "left_anti").select("path", "bytes", "rows", "version")
        shards = base["shards"] - len(removed) + added.count()
        left.unionByName(added.withColumn("version", F.lit(version).cast("long"))).coalesce(1 + shards // 100_000).write.parquet(f"{self.root}/{name}")
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        out = self._system.create(draft, False)
        out.write(json.dumps({"version": version, "manifest": name, "schema": schema, "shards": shards}).encode())
        out.close()
        self._system.mkdirs(self._path("versions"))
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        options[0] = getattr(self._fs, "Options$Rename").NONE
        try:
            self._files.rename(draft, self._path(f"versions/{version:012d}"), options)
        except Exception:
            self._system.delete(draft, False)
            if version in self.versions():
                return False
            raise
        return True

    # shards

    def _listed(self, folder: str) -> DataFrame:
        """(path, bytes, rows) of the files of a folder, counted by Spark."""
        meta = self.spark.read.schema("__none int").option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}").select("_metadata.file_path", "_metadata.file_size")
        inner = F.concat(F.lit(folder), F.substring_index("file_path", folder, -1))
        return meta.groupBy("file_path", "file_size").agg(F.count("*").alias("rows")).select(inner.alias("path"), F.col("file_size").alias("bytes"), "rows")

    def _shards(self, paths: list[str], schema: str, spark: SparkSession | None = None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        reader = (spark or self.spark).read.schema(kind)
        return reader.parquet(*(f"{self.root}/{p}" for p in paths)) if paths else (spark or self.spark).createDataFrame([], kind)

    def append(self, rows: DataFrame, arrival: F.Column | None = None) -> int:
        """Appends rows; with `arrival`, a column of integers, every value of it (null first) as an arrival with a version of its own, in one pass. Returns the last version."""
        folder, schema = f"data/{uuid.uuid4().hex}", rows.schema.json()
        known = self._pointer(None)["schema"]
        if known and json.loads(known) != json.loads(schema):
            raise ValueError("the store's shards have another schema")
        mark, taken = "__arrival", {c.lower() for c in rows.columns}
        while mark in taken:
            mark += "_"
        marked = rows.withColumn(mark, (F.lit(0) if arrival is None else arrival).cast("long"))
        marked.write.option("compression", "zstd").partitionBy(mark).parquet(f"{self.root}/{folder}")
        try:
            listed = self._listed(folder).withColumn("arrival", F.regexp_extract("path", mark + r"=(-?\d+|__HIVE_DEFAULT_PARTITION__)/", 1)).persist()
            values = [r["arrival"] for r in listed.select("arrival").distinct().collect()]
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
            listed, values = self.spark.createDataFrame([], "path string, bytes long, rows long, arrival string"), []
        for value in sorted(values, key=lambda v: int(v) if v.lstrip("-").isdigit() else -(2**63)) or [""]:
            while True:
                base = self._pointer(None)
                if base["schema"] and json.loads(base["schema"]) != json.loads(schema):
                    raise ValueError("the store's shards have another schema")
                if self._commit(base, listed.where(F.col("arrival") == value).drop("arrival"), [], schema):
                    break
        listed.unpersist()
        return self._pointer(None)["version"]

    def _tier(self) -> F.Column:
        return F.floor(F.log(F.greatest(F.col("bytes") / self.least_bytes, F.lit(1.0))) / F.log(F.lit(float(self.fanout))) + F.lit(1e-9))

    def compact(self) -> int:
        """Merges every tier that has `fanout` shards under the target size, until none has. Returns the last version."""
        spark = self.spark.newSession()
        for k, v in (("spark.sql.files.maxPartitionBytes", self.target_bytes), ("spark.sql.files.openCostInBytes", 1), ("spark.sql.files.minPartitionNum", 1)):
            spark.conf.set(k, str(v))
        full: list[int] = []
        while True:
            base = self._pointer(None)
            # Of shards under half the target at least two fit into one, so a merge always leaves fewer.
            small = self.manifest(base["version"]).where(F.col("bytes") < self.target_bytes // 2).withColumn("tier", self._tier())
            tiers = small.where(~F.col("tier").isin(full)).groupBy("tier").count().where(F.col("count") >= self.fanout).orderBy("tier").limit(1).collect()
            if not tiers:
                return base["version"]
            tier = tiers[0]["tier"]
            paths = [r["path"] for r in small.where(F.col("tier") == tier).orderBy("version", "path").limit(self.merge_files).collect()]
            folder = f"data/{uuid.uuid4().hex}"
            self._shards(paths, base["schema"], spark).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            added = self._listed(folder).persist()
            try:
                if added.count() >= len(paths):
                    # Nothing is won (a codec may have made them larger), and a next try would do the same.
                    full.append(tier)
                    self._drop(folder)
                else:
                    while not self._commit(base, added, paths, base["schema"]):
                        base = self._pointer(None)
                        if self._holding(base["version"], paths) < len(paths):
                            self._drop(folder)
                            break
            finally:
                added.unpersist()

    def _holding(self, version: int, paths: list[str]) -> int:
        """How many of the shards a version still has."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return self.manifest(version).join(asked, "path", "left_semi").count()

    def _drop(self, folder: str) -> None:
        self._system.delete(self._path(folder), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if None."""
        at = self._pointer(version)
        if not at["schema"]:
            raise ValueError("the store is empty")
        kind, live = StructType.fromJson(json.loads(at["schema"])), self.manifest(at["version"])
        folders = live.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n")).collect()
        have = {r["folder"]: r["n"] for r in folders}
        whole = [f for f, n in have.items() if self._files_in(f) == n]
        reader = self.spark.read.schema(kind)
        parts = [reader.parquet(*(f"{self.root}/{f}" for f in whole))] if whole else []
        rest = sorted(have.keys() - set(whole))
        if rest:
            rows = reader.parquet(*(f"{self.root}/{f}" for f in rest))
            mark = "__shard" + "_" * max(map(len, rows.columns), default=0)
            at_path = F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/data/", -1))
            parts.append(rows.withColumn(mark, at_path).join(live.select(F.col("path").alias(mark)), mark, "left_semi").select(*kind.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kind)

    def _files_in(self, folder: str) -> int:
        return sum(1 for f in self._system.listStatus(self._path(folder)) if f.getPath().getName().endswith(".parquet"))
