"""Drawdown episodes, runs, returns and performance along a series: islands and windows, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, series, trailing, whole


def drawdown(closes: DataFrame) -> DataFrame:
    """closes with peak (all-time high so far), dd, and peak_no, a number for each new strict high."""
    c = closes.withColumn("peak", F.max("close").over(whole()))
    fresh = F.when(F.col("peak") > F.coalesce(F.lag("peak").over(series()), F.lit(0.0)), 1).otherwise(0)
    return c.withColumn("dd", F.col("close") / F.col("peak") - 1).withColumn("fresh", fresh).withColumn("peak_no", F.sum("fresh").over(whole()))


def episodes(closes: DataFrame, threshold: float) -> DataFrame:
    """Falls of at least ``threshold`` below a peak: one between two strict new highs. Recovery is the next high, null if open.

    peak_no groups the rows between two highs, so an episode is a group, its breach the first row at the threshold and
    its trough the first least close.
    """
    d = drawdown(closes)
    at = lambda value, key: F.min_by(value, key)
    got = d.groupBy(SERIES, "peak_no").agg(
        F.min("pos").alias("peak_pos"), F.min("date").alias("peak_date"), F.first("peak").alias("peak"),
        F.min(F.when(F.col("dd") <= -threshold, F.col("pos"))).alias("breach_pos"),
        at("date", F.struct("close", "pos")).alias("trough_date"), at("pos", F.struct("close", "pos")).alias("trough_pos"), F.min("dd").alias("depth"),
    )
    by_peak = Window.partitionBy(SERIES).orderBy("peak_no")
    got = got.withColumn("recovery_pos", F.lead("peak_pos").over(by_peak)).filter(F.col("breach_pos").isNotNull())
    return got.withColumns({"to_trough": F.col("trough_pos") - F.col("peak_pos"), "to_recovery": F.col("recovery_pos") - F.col("trough_pos"), "extra": F.col("depth") + threshold})


def run_lengths(df: DataFrame, value: str) -> DataFrame:
    """series_id, run, value, first and last pos and length of each run of equal values."""
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(series())) & (F.row_number().over(series()) > 1), 0).otherwise(1)
    d = df.withColumn("change", change).withColumn("run", F.sum("change").over(whole()))
    return d.groupBy(SERIES, "run", value).agg(F.min("pos").alias("begin"), F.max("pos").alias("end"), F.count("*").alias("length"))


def allocation(df: DataFrame, weight: str, cost_bps: float = 5.0) -> DataFrame:
    """df with ret (of the series) and rule_ret: the weight of the session before earns it, less costs of its change."""
    w = F.col(weight)
    before = F.lag(w).over(series())
    ret = F.col("close") / F.lag("close").over(series()) - 1
    cost = cost_bps / 10_000 * F.abs(F.coalesce(before - F.lag(w, 2).over(series()), F.lit(0.0)))
    return df.withColumn("ret", ret).withColumn("rule_ret", (1 + before * F.col("ret")) * (1 - cost) - 1)


def performance(df: DataFrame, ret: str) -> DataFrame:
    """n, total and annual return, volatility, worst drawdown and months by series of daily returns ``ret``."""
    d = df.filter(F.col(ret).isNotNull()).withColumn("wealth", F.exp(F.sum(F.log1p(ret)).over(whole())))
    d = d.withColumn("fall", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(whole())) - 1)
    months = d.groupBy(SERIES, F.date_trunc("month", "date").alias("month")).agg(F.exp(F.sum(F.log1p(ret))).alias("m"))
    ends = months.groupBy(SERIES).agg((F.min("m") - 1).alias("worst_month"), (F.max("m") - 1).alias("best_month"))
    got = d.groupBy(SERIES).agg(F.count("*").alias("n"), F.sum(F.log1p(ret)).alias("log_total"), (F.stddev_samp(ret) * F.sqrt(F.lit(float(YEAR)))).alias("ann_vol"), F.min("fall").alias("max_dd"))
    got = got.select(SERIES, "n", (F.exp("log_total") - 1).alias("total"), (F.exp(F.col("log_total") * YEAR / F.col("n")) - 1).alias("cagr"), "ann_vol", "max_dd")
    return got.join(ends, SERIES)


def rolling_relative(df: DataFrame, a: str, b: str, length: int) -> DataFrame:
    """Differences of compounded returns over disjoint windows of ``length`` sessions: quantiles by series."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("k", F.row_number().over(series()) - 1)
    grow = lambda c: F.exp(F.sum(F.log1p(c)))
    got = d.groupBy(SERIES, F.floor(F.col("k") / length).alias("window")).agg(F.count("*").alias("n"), (grow(a) - grow(b)).alias("diff")).filter(F.col("n") == length)
    q = lambda p: F.percentile("diff", p)
    return got.groupBy(SERIES).agg(F.count("*").alias("windows"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.avg((F.col("diff") < 0).cast("double")).alias("share_behind"))


def calendar_relative(df: DataFrame, a: str, b: str) -> DataFrame:
    grow = lambda c: F.exp(F.sum(F.log1p(c)))
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return d.groupBy(SERIES, F.year("date").alias("year")).agg(F.count("*").alias("n"), (grow(a) - grow(b)).alias("diff"))


def churn(changed: Column, k: int = YEAR) -> Column:
    """Changes in the last k sessions, from the first session on."""
    return F.sum(changed.cast("long")).over(trailing(k))


def window_distribution(df: DataFrame, ret: str, length: int, step: int = 21) -> DataFrame:
    """Compounded returns of windows of ``length`` sessions that begin at every ``step``-th: quantiles and share below 0."""
    frame = series().rowsBetween(0, length - 1)
    d = df.filter(F.col(ret).isNotNull()).withColumn("k", F.row_number().over(series()) - 1)
    d = d.withColumn("n", F.count(ret).over(frame)).withColumn("g", F.exp(F.sum(F.log1p(ret)).over(frame)) - 1).filter((F.col("n") == length) & (F.col("k") % step == 0))
    q = lambda p: F.percentile("g", p)
    return d.groupBy(SERIES).agg(F.count("*").alias("windows"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.avg((F.col("g") < 0).cast("double")).alias("share_negative"))


def episode_returns(df: DataFrame, found: DataFrame, a: str, b: str) -> DataFrame:
    """Compounded returns of two return columns from each episode's peak to its trough: an interval join within a series."""
    e = found.select(SERIES, "peak_no", "peak_pos", "trough_pos")
    met = df.join(e, SERIES).filter((F.col("pos") > F.col("peak_pos")) & (F.col("pos") <= F.col("trough_pos")))
    grow = lambda c: F.exp(F.sum(F.log1p(F.coalesce(F.col(c), F.lit(0.0))))) - 1
    return met.groupBy(SERIES, "peak_no").agg(F.count("*").alias("n"), grow(a).alias("rule"), grow(b).alias("hold")).withColumn("saved", F.col("rule") - F.col("hold"))

