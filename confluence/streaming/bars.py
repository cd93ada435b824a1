"""Streaming refresh: late or corrected bars replace stored ones by (symbol, date), batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confluence.sources.federation import merged

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def upsert(batch: DataFrame, path: str) -> None:
    """Writes the months that a batch touches anew: stored bars, with the batch's in their place.

    Of several bars of one symbol and day the batch's largest wins, so a replayed batch changes nothing.
    """
    spark = batch.sparkSession
    fresh = batch.groupBy("symbol", "date").agg(F.max(F.struct("open", "high", "low", "close", "volume")).alias("b")).select("symbol", "date", "b.*")
    fresh = fresh.withColumn("month", F.date_format("date", "yyyy-MM"))
    try:
        stored = spark.read.schema(f"{SCHEMA}, month string").parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], f"{SCHEMA}, month string")
    touched = stored.join(fresh.select("month").distinct(), "month", "left_semi").select(fresh.columns)
    # the result replaces files that it reads, so it is made whole before
    whole = merged(touched, fresh, ["symbol", "date"]).persist()
    whole.count()
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    whole.unpersist()


def refresh(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """A query that takes all bars of new files in ``source`` into ``path``, then stops."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
