"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python: long texts make large rows.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Arrow batches are kept small from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Where the session names none (a local session, as in tests) one below /tmp is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/confluence-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here and an executor's loss costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that can go once their readers have run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        """Delete all of them through Spark's file system layer."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def id_set_bits(ids: DataFrame, column: str, log2_bits: int = 24, hashed: bool = False) -> bytes:
    """A Bloom filter of one hash over ``column``: at most 2**log2_bits bits whatever the input.

    It only saves work: rows whose id is absent may pass, rows whose id is there always do.  ``hashed`` ids
    are their own hashes.
    """
    import numpy as np

    h = F.pmod(F.col(column) if hashed else F.xxhash64(F.col(column)), F.lit(1 << log2_bits))
    words = (
        ids.select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()

