"""A store of runs: partitioned Parquet folders behind a manifest that is swapped in one step.

A write makes new folders for the partitions that it changes and then a manifest, ``_manifests/<version>.json``, that names
every partition's folder.  Readers follow the newest manifest, so they see a write whole or not at all; a write
that fails leaves folders that no manifest names.  Two writers from one version can't both succeed: manifests are renamed into
place without overwriting, and the second gets ``Conflict``.  The store must rename atomically, as local disks and HDFS do.

Partitions keep the columns that they were written with; columns that came later are null in older ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class Conflict(Exception):
    """Someone else has written the next version."""


class Store:
    """Rows by ``partition`` (a run) and other keys, with replacing, upserting and column-wise writes."""

    def __init__(self, spark: SparkSession, path: str, partition: str = "run_id"):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # the manifest

    def _place(self, name: str):
        where = self._hadoop.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        where, fs = self._place(MANIFESTS)
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, parts: {partition: folder}}; of a store that nothing was written to an empty one."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "parts": {}}
        row = self.spark.read.text(f"{self.path}/{MANIFESTS}/{version}.json", wholetext=True).first()
        return json.loads(row.value)

    def _commit(self, old: dict, parts: dict[str, str], schema: StructType) -> int:
        version = old["version"] + 1
        known = {f.name: f for f in (StructType.fromJson(old["schema"]).fields if old["schema"] else [])}
        for f in schema.fields:
            if f.name in known and known[f.name].dataType != f.dataType:
                raise TypeError(f"{f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            known.setdefault(f.name, f)
        text = json.dumps({"version": version, "schema": StructType(list(known.values())).jsonValue(), "parts": old["parts"] | parts})
        draft, fs = self._place(f"{MANIFESTS}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._place(f"{MANIFESTS}/{version}.json")
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} is there already") from error
            raise
        return version

    # reading

    def load(self, parts: list | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some partitions, whose folders alone are read; as of a version if one is given."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise LookupError(f"nothing has been written to {self.path}")
        wanted = found["parts"] if parts is None else {str(p): found["parts"][str(p)] for p in parts if str(p) in found["parts"]}
        schema = StructType.fromJson(found["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in sorted(wanted.values())])

    # writing

    def _written(self, old: dict, rows: DataFrame) -> int:
        """Replaces the partitions that ``rows`` has; one exchange by partition, one folder each."""
        batch = uuid.uuid4().hex
        key = F.coalesce(F.col(self.partition).cast("string"), F.lit("null"))
        try:
            rows.withColumn("_part", key).write.partitionBy("_part").parquet(f"{self.path}/{batch}")
        except PySparkException:
            where, fs = self._place(batch)
            fs.delete(where, True)
            raise
        where, fs = self._place(batch)
        names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return self._commit(old, {unescape(n.removeprefix("_part=")): f"{batch}/{n}" for n in names}, rows.schema)

    def write(self, rows: DataFrame) -> int:
        """Replaces whole partitions: those that ``rows`` has.  Gives the new version."""
        return self._written(self.manifest(), rows)

    def _touched(self, old: dict, rows: DataFrame) -> DataFrame:
        """The stored rows of the partitions that ``rows`` has (a write touches few runs)."""
        names = [r[0] for r in rows.select(F.coalesce(F.col(self.partition).cast("string"), F.lit("null"))).distinct().collect()]
        return self.load(names, old["version"])

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Inserts rows, and replaces whole rows that have the same keys; null keys are equal to each other."""
        old = self.manifest()
        if old["schema"] is None:
            return self._written(old, rows)
        stored = self._touched(old, rows)
        stays = stored.alias("s").join(rows.select(*keys).distinct().alias("r"), [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left_anti")
        return self._written(old, stays.unionByName(rows, allowMissingColumns=True))

    def update(self, rows: DataFrame, keys: list[str]) -> int:
        """Sets the columns of ``rows`` that aren't keys in the stored rows that have its keys.

        Other columns and other rows stay; rows whose keys aren't stored add nothing.  Columns may be new.  Keys must
        not repeat.
        """
        old = self.manifest()
        if old["schema"] is None:
            raise LookupError(f"nothing has been written to {self.path}")
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError("a key repeats")
        stored, fresh = self._touched(old, rows), [c for c in rows.columns if c not in keys]
        held = rows.select(*keys, F.struct(*fresh).alias("_new"))
        both = stored.alias("s").join(held.alias("r"), [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
        columns = [F.col(f"s.{c}") for c in stored.columns if c not in fresh]
        columns += [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"s.{c}") if c in stored.columns else F.lit(None)).alias(c) for c in fresh]
        return self._written(old, both.select(columns))

    def clean(self, keep: int = 2) -> int:
        """Deletes what only versions before the newest ``keep`` name, and what no version names; how many folders went.  No writer may run meanwhile."""
        stay = self.versions()[-keep:]
        named = {folder for v in stay for folder in self.manifest(v)["parts"].values()}
        where, fs = self._place("")
        gone = 0
        for batch in [f for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName() != MANIFESTS]:
            name = batch.getPath().getName()
            parts = [f.getPath() for f in fs.listStatus(batch.getPath()) if f.isDirectory()]
            old = [p for p in parts if f"{name}/{p.getName()}" not in named]
            for p in old:
                fs.delete(p, True)
            if len(old) == len(parts):
                fs.delete(batch.getPath(), True)
            gone += len(old)
        for v in self.versions()[:-keep]:
            fs.delete(self._place(f"{MANIFESTS}/{v}.json")[0], False)
        return gone
