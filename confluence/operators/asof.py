"""As-of joins that a hot key doesn't bind to one task: rows meet within (key, stretch of time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _number(time: str, df: DataFrame) -> Column:
    """Days of dates, seconds of timestamps, numbers as they are."""
    kind = df.schema[time].dataType.typeName()
    if kind == "date":
        return F.unix_date(time)
    return F.col(time).cast("double") if kind in ("timestamp", "timestamp_ntz") else F.col(time)


def join(left: DataFrame, right: DataFrame, key: str, time: str, span: float, values: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Each row of ``left`` with ``values`` of the newest row of ``right`` of its key up to its time (before it unless ``exact``).

    Time is cut into stretches of ``span`` (days for dates, seconds for timestamps, else the column's unit).  A stretch's rows
    meet in one group; what the stretches before it end with comes from one row for each (key, stretch), carried on by a
    window over those rows alone.  So a task holds one stretch of a key, not a key, and ``span`` says how much that is.

    Left rows without a key, a time or a match get nulls; they don't enter the shuffle if they lack one.  Right rows without
    a key or a time match nothing.  Of right rows with one key and time, that with the largest values (in order) counts;
    nulls among the values are values.  Columns of ``left`` keep their names; those of ``values`` must differ.
    """
    values = [c for c in right.columns if c not in (key, time)] if values is None else values
    if clash := sorted(set(values) & set(left.columns)):
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    stretch = lambda df: F.floor(_number(time, df) / span)
    whole = F.col(key).isNotNull() & F.col(time).isNotNull()
    held = F.struct(*values)
    own = left.filter(whole).select(F.col(key).alias("_key"), stretch(left).alias("_part"), F.col(time).alias("_time"), F.struct(*left.columns).alias("_left"))
    other = right.filter(whole).select(F.col(key).alias("_key"), stretch(right).alias("_part"), F.col(time).alias("_time"), held.alias("_held"))
    # the last row of each stretch, and for the stretches with left rows that of those before
    ends = other.groupBy("_key", "_part").agg(F.max(F.struct("_time", "_held")).alias("_end")).select("_key", "_part", F.col("_end._held").alias("_end"), F.lit(False).alias("_asks"))
    asks = own.select("_key", "_part").distinct().withColumn("_asks", F.lit(True))
    parts = ends.unionByName(asks, allowMissingColumns=True).groupBy("_key", "_part").agg(F.first("_end", ignorenulls=True).alias("_end"), F.bool_or("_asks").alias("_asks"))
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    heads = parts.withColumn("_held", F.last("_end", ignorenulls=True).over(before)).filter("_asks and _held is not null").select("_key", "_part", "_held")
    # in a stretch: what it begins with, then by time; at one time right rows come first if they count
    rank = lambda n: F.lit(n).alias("_rank")
    rows = (
        heads.select("*", rank(0)).unionByName(other.select("*", rank(1 if exact else 2)), allowMissingColumns=True)
        .unionByName(own.select("*", rank(2 if exact else 1)), allowMissingColumns=True)
    )
    order = W.partitionBy("_key", "_part").orderBy(F.col("_time").asc_nulls_first(), "_rank", "_held").rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumn("_met", F.last("_held", ignorenulls=True).over(order)).filter("_left is not null")
    out = met.select("_left.*", *[F.col("_met")[v].alias(v) for v in values])
    rest = left.filter(~whole).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return out.unionByName(rest)
