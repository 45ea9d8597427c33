"""Bars and index series from the driver's tables: the engine's long, series-partitioned inputs.

``bars`` are open, high, low and close of ``events`` by type and time unit. ``index_bars`` turns daily average prices of
``lineitem`` into a price-like path per supplier group: standardised averages become returns, which are summed. Every
frame has series_id, date and pos, the row's place in its series; horizons and lags count places, not days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, series, trailing

GROUPS = 4
SCALE, DRIFT = 0.011, 0.0002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_pos(df: DataFrame, order: str = "date") -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(SERIES).orderBy(order)))


def bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Bars of positive event values by series and unit; the last bar of each series may be partial."""
    ticks = table(spark, sf_dir, "events").filter("value > 0").select(F.col("event_type").alias(SERIES), F.date_trunc(unit, "ts").alias("bar"), "ts", "value")
    return ticks.groupBy(SERIES, "bar").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )


def _path(daily: DataFrame) -> DataFrame:
    """series_id, date, close, pos from daily averages ``a``."""
    every = Window.partitionBy(SERIES)
    by_date = Window.partitionBy(SERIES).orderBy("date")
    ret = SCALE * (F.col("a") - F.avg("a").over(every)) / F.stddev_samp("a").over(every) + DRIFT
    paths = daily.withColumn("r", ret).select(SERIES, "date", (100 * F.exp(F.sum("r").over(by_date))).alias("close"))
    return with_pos(paths)


def index_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") % GROUPS).alias(SERIES), F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    return _path(lines.groupBy(SERIES, "date").agg(F.avg("l_extendedprice").alias("a")))


def part_close(spark: SparkSession, sf_dir: str, key: str, n: int) -> DataFrame:
    """Paths of n parts of each series, by a key of the lines: series_id, ticker, date, close."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") % GROUPS).alias(SERIES), (F.floor(F.col(key) / 4) % n).alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    daily = lines.groupBy(SERIES, "ticker", "date").agg(F.avg("l_extendedprice").alias("a"))
    every = Window.partitionBy(SERIES, "ticker")
    ret = SCALE * (F.col("a") - F.avg("a").over(every)) / F.stddev_samp("a").over(every) + DRIFT
    return daily.withColumn("r", ret).select(SERIES, "ticker", "date", (100 * F.exp(F.sum("r").over(every.orderBy("date")))).alias("close"))


def other_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second index, of orders by customer group; some dates of the first are missing."""
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % GROUPS).alias(SERIES), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return _path(lines.groupBy(SERIES, "date").agg(F.avg("o_totalprice").alias("a")))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_close with open (the close before), high and low around them by a fixed pattern."""
    c = index_close(spark, sf_dir).withColumn("open", F.coalesce(F.lag("close").over(series()), F.col("close")))
    high = F.greatest("open", "close") * (1 + 0.001 * (1 + F.col("pos") % 5))
    low = F.least("open", "close") * (1 - 0.001 * (1 + F.col("pos") % 3))
    return c.select(SERIES, "date", "pos", "open", high.alias("high"), low.alias("low"), "close")


def pseudo_vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised 22-day volatility of the second index in percent: series_id, date, vix."""
    r = F.ln(F.col("close") / F.lag("close").over(series()))
    v = other_close(spark, sf_dir).withColumn("r2", r * r)
    vix = F.when(F.count("r2").over(trailing(22)) == 22, 100 * F.sqrt(252 * F.avg("r2").over(trailing(22))))
    return v.select(SERIES, "date", vix.alias("vix"))
