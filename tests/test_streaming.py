import datetime

from confluence.streaming import bars


def test_corrected_bars_replace_stored_ones(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda d, close: ("A", datetime.date(2024, 1, d), 1.0, 2.0, 0.5, close, 10.0)
    for batch in ([day(1, 1.0), day(2, 2.0)], [day(2, 2.5), day(3, 3.0)]):
        spark.createDataFrame(batch, bars.SCHEMA).write.mode("append").parquet(source)
        query = bars.refresh(spark, source, path, checkpoint)
        query.awaitTermination(120)
    assert [(r.date.day, r.close) for r in spark.read.parquet(path).orderBy("date").collect()] == [(1, 1.0), (2, 2.5), (3, 3.0)]
