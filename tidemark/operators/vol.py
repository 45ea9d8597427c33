"""Variances, volatilities, distances and barrier probabilities along a series: windows over places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, ahead, clip, full, phi, series, trailing

FLOOR = 1e-8
HAR = (1, 5, 22)
SMA, FILL, H, DD = 180, 3, 20, 0.05


def floored(x: Column, floor: float = FLOOR) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))


def garman_klass(overnight: bool = True) -> Column:
    inside = 0.5 * F.pow(F.ln(F.col("high") / F.col("low")), 2) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), 2)
    gap = F.pow(F.ln(F.col("open") / F.lag("close").over(series())), 2)
    return floored(inside + gap if overnight else inside)


def parkinson() -> Column:
    return floored(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0))))


def close_to_close() -> Column:
    return floored(F.pow(log_return(), 2))


def log_return(k: int = 1) -> Column:
    return F.ln(F.col("close") / F.lag("close", k).over(series()))


def har_components(bars: DataFrame, variance: Column) -> DataFrame:
    """bars with var and rv1, rv5, rv22: annualised roots of mean variances of full windows."""
    out = bars.withColumn("var", variance)
    return out.withColumns({f"rv{k}": F.sqrt(YEAR * floored(full(F.col("var"), F.avg("var"), trailing(k), k))) for k in HAR})


def har_log_vol() -> Column:
    return sum(F.ln(f"rv{k}") for k in HAR) / len(HAR)


def sma_distance(k: int = SMA) -> Column:
    return F.col("close") / full(F.col("close"), F.avg("close"), trailing(k), k) - 1


def realized_vol(returns: Column, k: int = H) -> Column:
    return full(returns, F.stddev_samp(returns), trailing(k), k) * F.sqrt(F.lit(float(YEAR)))


def har_target(returns: Column, h: int = H) -> Column:
    """Logarithm of the annualised volatility of the next h returns; null where it is 0 or not yet known."""
    v = full(returns, F.stddev_samp(returns), ahead(h), h)
    return F.when(v > 0, F.ln(v * F.sqrt(F.lit(float(YEAR)))))


def barrier_probability(vol: Column, dd: float = DD, h: int = H, drift: bool = True, bgk: bool = False) -> Column:
    """Probability that a path of annual volatility ``vol`` falls by dd within h sessions (reflection principle).

    bgk shifts the barrier for daily monitoring. phi's error, below 7.5e-8, is the only approximation.
    """
    s = vol * F.sqrt(F.lit(h / YEAR))
    b = F.lit(math.log(1 - dd)) - (F.lit(0.5826) * vol / F.sqrt(F.lit(float(YEAR))) if bgk else F.lit(0.0))
    m = -s * s / 2 if drift else F.lit(0.0)
    p = phi((b - m) / s) + F.exp(2 * m * b / (s * s)) * phi((b + m) / s)
    return F.when(vol > 0, p)


def ffill(df: DataFrame, values: DataFrame, column: str, limit: int = FILL) -> DataFrame:
    """df with a column of values joined by series and date and carried forward over at most ``limit`` rows."""
    return df.join(values.select(SERIES, "date", column), [SERIES, "date"], "left").withColumn(column, F.last(column, ignorenulls=True).over(trailing(limit + 1)))


def features(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """The feature frame: volatilities, HAR, trend distance, aligned VIX, barrier probabilities and their logits."""
    f = har_components(ffill(bars, vix, "vix"), garman_klass())
    f = f.withColumns({"pk": parkinson(), "cc": close_to_close(), "har": har_log_vol(), "ma": sma_distance(), "r": log_return()})
    v = F.col("vix") / 100
    f = f.withColumns({"rv20": realized_vol(F.col("r")), "p_vix": barrier_probability(v), "p_vix0": barrier_probability(v, drift=False), "p_bgk": barrier_probability(v, bgk=True)})
    p = clip(F.col("p_vix"), 1e-6, 1 - 1e-6)
    return f.withColumns({"x_vix": F.ln(p / (1 - p)), "x_har": F.col("har"), "x_ma": F.col("ma")})


def regime_observations(bars: DataFrame, k: int = 10) -> DataFrame:
    """bars with r100, the log return in hundredths, and ln_rv10, the log of the annualised root mean square of k returns."""
    out = bars.withColumn("_r", log_return())
    squares = full(F.col("_r"), F.avg(F.col("_r") * F.col("_r")), trailing(k), k)
    return out.withColumns({"r100": 100 * F.col("_r"), "ln_rv10": F.ln(F.sqrt(YEAR * floored(squares)))}).drop("_r")


def percentile_rank(value: str, k: int = 252, least: int = 60) -> Column:
    """Share of the last k values below the current one, ties half; null below ``least`` values."""
    held = F.collect_list(value).over(trailing(k))
    x = F.col(value)
    below, equal = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(held) >= least), (below + (equal + 1) / 2) / F.size(held))


def targets(closes: DataFrame) -> DataFrame:
    """Forward labels; null until all of their horizon is known."""
    c, out = F.col("close"), closes.withColumn("r", log_return())
    for h in (5, 20, 60):
        out = out.withColumn(f"fwd_ret_{h}", F.lead("close", h).over(series()) / c - 1).withColumn(f"y_sign_{h}", F.when(F.col(f"fwd_ret_{h}").isNotNull(), (F.col(f"fwd_ret_{h}") > 0).cast("int")))
    for h in (20, 60):
        out = out.withColumn(f"fwd_maxdd_{h}", F.least(F.lit(0.0), full(c, F.min("close"), ahead(h), h) / c - 1))
        out = out.withColumn(f"fwd_maxdd_{h}", F.when(F.lead("close", h).over(series()).isNotNull(), F.col(f"fwd_maxdd_{h}")))
    label = lambda x, at: F.when(x.isNotNull(), (x <= at).cast("int"))
    out = out.withColumns({"y_dd5_20": label(F.col("fwd_maxdd_20"), -0.05), "y_dd10_60": label(F.col("fwd_maxdd_60"), -0.10), "rv20": realized_vol(F.col("r"))})
    median = F.when(F.count("rv20").over(trailing(252)) == 252, F.percentile("rv20", 0.5).over(trailing(252)))
    out = out.withColumns({"rv20_ref": median, "fwd_rv20": F.lead("rv20", 20).over(series())})
    return out.withColumn("y_vol_20", F.when(F.col("fwd_rv20").isNotNull() & F.col("rv20_ref").isNotNull(), (F.col("fwd_rv20") > F.col("rv20_ref")).cast("int")))


def ratio_checks(bars: DataFrame, k: int = 250) -> DataFrame:
    """By series: range of the ratios of estimators over k sessions, bars that contradict themselves, opens at the close before."""
    d = bars.withColumns({"gk": garman_klass(), "pk": F.when(log_return().isNotNull(), parkinson()), "cc": close_to_close(), "before": F.lag("close").over(series())})
    ratio = lambda c: F.sqrt(full(F.col(c), F.avg(c), trailing(k), k) / F.avg("cc").over(trailing(k)))
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)
    d = d.withColumns({"gk_cc": ratio("gk"), "pk_cc": ratio("pk"), "bad": bad.cast("long"), "same": F.coalesce(F.col("open") == F.col("before"), F.lit(False)).cast("double")})
    return d.groupBy(SERIES).agg(
        F.count("gk_cc").alias("n"), F.min("gk_cc").alias("gk_low"), F.percentile("gk_cc", 0.5).alias("gk_median"), F.max("gk_cc").alias("gk_high"), F.min("pk_cc").alias("pk_low"), F.max("pk_cc").alias("pk_high"), F.sum("bad").alias("bad_bars"), F.avg("same").alias("share_open_at_close")
    )
