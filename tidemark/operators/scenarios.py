"""What followed: outcomes by pooled probability bins and by state, live rates beside them, and ranges from a volatility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, ahead, wilson
from tidemark.operators import fit, vol
from tidemark.operators.scoring import BINS, bin_of

LEAST_N_EFF, DIV = 20.0, 20
Z = {"1s": 1.0, "80": 1.2816, "90": 1.645}
NOMINAL = {"1s": 0.6827, "80": 0.80, "90": 0.90}
STATES = ("normal", "caution", "reduce")


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows of counts (by, bin, n, with a row for every bin) with ``pool``: adjacent bins together until n_eff is enough.

    From the lowest bin on, a pool closes as soon as it has LEAST_N_EFF; a tail that doesn't reach it joins the pool
    before it. The fold goes over the nine counts of a group, an array in its row.
    """
    start = F.struct(F.lit(0).alias("pool"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("pools"))

    def step(s: Column, n: Column) -> Column:
        held = s["held"] + n
        full = held / DIV >= LEAST_N_EFF
        return F.struct(F.when(full, s["pool"] + 1).otherwise(s["pool"]).alias("pool"), F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), F.array_append(s["pools"], s["pool"]).alias("pools"))

    counts = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", F.col("n").cast("long").alias("n")))).alias("bins"))  # one for each bin
    found = counts.withColumn("s", F.aggregate(F.transform("bins", lambda b: b["n"]), start, step))
    # the number of pools that closed; an open tail belongs to the last of them
    last = F.greatest(F.col("s.pool") - 1, F.lit(0))
    pools = F.transform("s.pools", lambda p: F.least(p, last))
    return found.select(*by, F.posexplode(pools).alias("bin", "pool"))


def outcome_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, observed rate with its interval, and quantiles of what followed, for groups of rows (y, ret, mdd, ep10, and by)."""
    q = lambda c, p: F.percentile(c, p)
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("y").alias("obs"), q("ret", 0.1).alias("ret_p10"), q("ret", 0.5).alias("ret_p50"), q("ret", 0.9).alias("ret_p90"), q("mdd", 0.1).alias("mdd_p10"), q("mdd", 0.5).alias("mdd_p50"),
        F.avg(F.col("ep10").cast("double")).alias("share_ep10"), F.avg("p").alias("mean_p"),
    )
    n_eff = F.col("n") / DIV
    low, high = wilson(F.col("obs"), n_eff)
    return got.withColumns({"n_eff": n_eff, "wilson_low": low, "wilson_high": high, "grey": n_eff < LEAST_N_EFF})


def starts_within(is_start: Column, h: int = vol.H) -> Column:
    """Whether an episode begins in the next h rows; the last rows see what is left."""
    return F.coalesce(F.max(is_start.cast("int")).over(ahead(h)), F.lit(0)) == 1


def bin_table(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Pooled probability bins by series: edges, counts, rates, quantiles. rows: p, y, ret, mdd, ep10."""
    binned = rows.filter("p is not null and y is not null").withColumn("bin", bin_of(F.col("p")))
    # the bins are nine
    grid = binned.select(SERIES).distinct().join(spark.range(len(BINS) - 1).select(F.col("id").cast("int").alias("bin")))
    counts = grid.join(binned.groupBy(SERIES, "bin").agg(F.count("*").alias("n")), [SERIES, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pools = pooled(counts, [SERIES])
    edges = F.array(*map(F.lit, BINS))
    spans = pools.groupBy(SERIES, "pool").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    spans = spans.select(SERIES, "pool", F.get(edges, F.col("first")).alias("bin_low"), F.get(edges, F.col("last") + 1).alias("bin_high"), (F.col("last") - F.col("first") + 1).alias("n_bins"))
    return spans.join(outcome_cells(binned.join(pools, [SERIES, "bin"]), [SERIES, "pool"]), [SERIES, "pool"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def state_table(rows: DataFrame, spark: SparkSession, order: tuple[str, ...] = STATES) -> DataFrame:
    """The same by decision state, without pooling: each state of the order has a row, others follow."""
    known = rows.filter("y is not null and state is not null")
    grid = known.select(SERIES).distinct().join(spark.createDataFrame([(s,) for s in order], "state string"))
    every = grid.unionByName(known.select(SERIES, "state").distinct()).distinct()
    n = F.coalesce("n", F.lit(0))
    return every.join(outcome_cells(known, [SERIES, "state"]), [SERIES, "state"], "left").withColumns({"n": n, "n_eff": n / DIV, "grey": n / DIV < LEAST_N_EFF})


def live_column(table: DataFrame, live: DataFrame) -> DataFrame:
    """table (bin_low, bin_high, wilson_low, wilson_high by series) with live counts, rate, interval and whether it drifts out."""
    w = Window.partitionBy(SERIES)
    spans = table.select(SERIES, "pool", "bin_low", "bin_high", (F.col("bin_high") == F.max("bin_high").over(w)).alias("is_last"))
    inside = (F.col("p") >= F.col("bin_low")) & ((F.col("p") < F.col("bin_high")) | F.col("is_last") & (F.col("p") == F.col("bin_high")))
    met = live.filter("p is not null and y is not null").join(spans, SERIES).filter(inside).groupBy(SERIES, "pool").agg(F.count("*").alias("live_n"), F.avg("y").alias("live_obs"))
    got = table.join(met, [SERIES, "pool"], "left").withColumn("live_n", F.coalesce("live_n", F.lit(0)))
    n_eff = F.col("live_n") / DIV
    low, high = wilson(F.col("live_obs"), n_eff)
    drift = F.coalesce(~F.col("live_obs").between(F.col("wilson_low"), F.col("wilson_high")), F.lit(False))
    return got.withColumns({"live_n_eff": n_eff, "live_low": low, "live_high": high, "live_grey": n_eff < LEAST_N_EFF, "drift": drift})


def bin_of_today(table: DataFrame, today: DataFrame) -> DataFrame:
    """The row of table for each series' p of today."""
    w = Window.partitionBy(SERIES)
    t = table.withColumn("is_last", F.col("bin_high") == F.max("bin_high").over(w))
    inside = (F.col("p_today") >= F.col("bin_low")) & ((F.col("p_today") < F.col("bin_high")) | F.col("is_last") & (F.col("p_today") == F.col("bin_high")))
    return today.select(SERIES, F.col("p").alias("p_today")).join(t, SERIES).filter(inside).drop("is_last")


def undisplayable(table: DataFrame) -> DataFrame:
    """Rows that may not be shown: without a count, or with rows but without an interval."""
    return table.filter("n is null or n_eff is null or (n > 0 and wilson_low is null)")


def median_interval(rows: DataFrame, value: str, by: list[str], block: int = 40, draws: int = 2000, seed: int = 0, q: float = 0.5) -> DataFrame:
    """Circular block bootstrap of a quantile."""
    return fit.block_bootstrap(rows, value, by, block, draws, seed, quantile=q)


def ranges(spot: Column, sigma: Column, h: int = vol.H) -> Column:
    """Bands of a lognormal price in h sessions for annual volatility sigma: an array of (band, low, high); null without one."""
    move = lambda z: z * sigma * math.sqrt(h / YEAR)
    bands = F.array(*(F.struct(F.lit(k).alias("band"), (spot * F.exp(-move(z))).alias("low"), (spot * F.exp(move(z))).alias("high")) for k, z in Z.items()))
    return F.when((spot > 0) & (sigma > 0), bands)


def range_label(hit: Column, n_eff: Column, band: str) -> Column:
    """Whether a band's share of hits is too narrow, too wide, about right, or unknown, by its interval."""
    low, high = wilson(hit, n_eff)
    return F.when(hit.isNull() | (n_eff < LEAST_N_EFF), "unknown").when(high < NOMINAL[band], "narrow").when(low > NOMINAL[band], "wide").otherwise("fair")
