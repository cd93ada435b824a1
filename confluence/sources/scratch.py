"""Intermediate tables in the folder that driver and executors share: plans stay short, and a lost executor costs nothing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session that names none gets one below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/confluence-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Held:
    """Tables that are written once and read by many plans, until they are released."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def release(self) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


#: (application, name, data folder) -> (state of the tables, what was made, its paths).
_ONCE: dict = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the tables' files: what is derived from them is good while this stays the same."""
    where = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[str], object]) -> str:
    """The path of a folder that ``make`` fills once for a session and a state of the tables; gone when Python ends."""
    key, now = (spark.sparkContext.applicationId, name, sf_dir), state(spark, sf_dir)
    if key not in _ONCE or _ONCE[key][0] != now:
        if key in _ONCE:
            _ONCE[key][1].release()
        held = Held(spark)
        held.paths.append(shared_dir(spark))
        make(held.paths[0])
        _ONCE[key] = (now, held)
    return _ONCE[key][1].paths[0]


def release(spark: SparkSession) -> None:
    """Deletes what ``once`` holds for a session."""
    for key in [k for k in _ONCE if k[0] == spark.sparkContext.applicationId]:
        _ONCE.pop(key)[1].release()


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)
