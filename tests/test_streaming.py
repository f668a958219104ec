import datetime as dt

from fluvia.streaming.daily import daily_means


def test_daily_means_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    parts = ([("a", at(1, 3), 1.0), ("a", at(1, 5), 3.0), ("b", at(1, 6), 7.0)], [("a", at(9, 1), 5.0)], [("a", at(1, 7), 100.0), ("a", at(9, 2), 7.0), ("a", at(20, 1), 0.0)], [("b", at(21, 1), 0.0)])
    for rows in parts:  # files in order; the late row comes when its day is closed
        spark.createDataFrame(rows, "site string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)
        stream = daily_means(spark.readStream.schema("site string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.site, r.d): r.value for r in spark.read.parquet(out).collect()}
    assert got[("a", dt.date(2024, 1, 1))] == 2.0 and got[("b", dt.date(2024, 1, 1))] == 7.0 and got[("a", dt.date(2024, 1, 9))] == 6.0
