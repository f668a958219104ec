"""Extension: daily means of a stream, late rows within a watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, time: str = "ts", value: str = "value", keys: tuple[str, ...] = ("site",), late: str = "2 days") -> DataFrame:
    days = stream.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day").alias("w")).agg(F.avg(value).alias("value"))
    return days.select(*keys, F.to_date("w.start").alias("d"), "value")
