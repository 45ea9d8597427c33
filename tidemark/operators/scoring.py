"""Scores of probability forecasts: Brier, skill, AUC, reliability, Murphy parts, phase offsets, Diebold-Mariano."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, ratio, series, wilson
from tidemark.operators import vol

PURGE, OFFSETS, HAC = 20, 20, 19
#: Fixed edges of the reliability bins; the last bin is closed.
BINS = (0.0, 0.08, 0.12, 0.16, 0.20, 0.25, 0.30, 0.40, 0.50, 1.0)


def climatology(y: str = "y", purge: int = PURGE) -> Column:
    """Mean of the labels that were known ``purge`` sessions ago: expanding, point in time."""
    return F.avg(y).over(series().rowsBetween(Window.unboundedPreceding, -purge - 1))


def forecasts(bars: DataFrame) -> DataFrame:
    """series_id, date, pos, block (year), y, p, clim on rows where all are known. p: barrier probability from rv22."""
    f = vol.har_components(bars, vol.garman_klass())
    f = vol.targets(f).withColumn("p", vol.barrier_probability(F.col("rv22"))).withColumnRenamed("y_dd5_20", "y")
    f = f.withColumn("clim", climatology()).select(SERIES, "date", "pos", F.year("date").alias("block"), "y", "p", "clim", "fwd_ret_20", "rv22")
    return f.dropna(subset=["y", "p", "clim"])


def loss(p: str) -> Column:
    return F.pow(F.col(p) - F.col("y"), 2)


def block_scores(oos: DataFrame) -> DataFrame:
    """Brier, reference Brier and skill by series and block, and over all blocks (block null)."""
    cells = oos.withColumns({"lp": loss("p"), "lc": loss("clim")}).groupingSets([[F.col(SERIES), F.col("block")], [F.col(SERIES)]], SERIES, "block")
    got = cells.agg(F.count("*").alias("n"), F.avg("lp").alias("brier"), F.avg("lc").alias("brier_clim"), (F.avg("p") - F.avg("y")).alias("bias"))
    return got.withColumn("skill", 1 - ratio(F.col("brier"), F.col("brier_clim")))


def auc(oos: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve with average ranks of ties; null where only one class occurs.

    Ties are counted first, so the window sees distinct scores only.
    """
    ties = oos.groupBy(*by, score).agg(F.count("*").alias("k"), F.sum("y").alias("ones"))
    below = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", below + (F.col("k") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("ones").alias("pos"), F.sum(F.col("ones") * F.col("rank")).alias("ranks"))
    neg = F.col("n") - F.col("pos")
    return sums.select(*by, "n", "pos", ratio(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, (F.col("pos") * neg).cast("double")).alias("auc"))


def bin_of(p: Column) -> Column:
    """Number of the bin [low, high) of p, the last closed; null outside."""
    chain = F.when(p < BINS[0], None)
    for i, high in enumerate(BINS[1:]):
        chain = chain.when((p <= high) if i == len(BINS) - 2 else (p < high), i)
    return chain


def reliability(oos: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean forecast, observed share and its interval per bin; n_eff counts disjoint horizons."""
    got = oos.groupBy(*by, bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))
    low, high = wilson(F.col("observed"), F.col("n") / vol.H)
    return got.select(*by, "bin", "n", (F.col("n") / vol.H).alias("n_eff"), "mean_p", "observed", low.alias("low"), high.alias("high"))


def murphy(oos: DataFrame, by: list[str]) -> DataFrame:
    """Reliability, resolution and uncertainty of the binned forecasts; they sum to the binned Brier score."""
    bins = oos.groupBy(*by, bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("f"), F.avg("y").alias("o"))
    w = Window.partitionBy(*by)
    bins = bins.withColumn("base", F.sum(F.col("n") * F.col("o")).over(w) / F.sum("n").over(w))
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"),
        mean(F.pow(F.col("f") - F.col("o"), 2)).alias("reliability"),
        mean(F.pow(F.col("o") - F.col("base"), 2)).alias("resolution"),
        (F.first("base") * (1 - F.first("base"))).alias("uncertainty"),
    )


def phase_offsets(oos: DataFrame, offsets: int = OFFSETS) -> DataFrame:
    """Skill on each of the subsamples of every 20th session."""
    got = oos.groupBy(SERIES, ((F.col("pos") - 1) % offsets).alias("phase")).agg(F.count("*").alias("n"), F.avg(loss("p")).alias("bp"), F.avg(loss("clim")).alias("bc"))
    return got.select(SERIES, "phase", "n", (1 - ratio(F.col("bp"), F.col("bc"))).alias("skill"))


def phase_summary(oos: DataFrame) -> DataFrame:
    s = F.col("skill")
    return phase_offsets(oos).groupBy(SERIES).agg(F.min(s).alias("low"), F.percentile(s, 0.5).alias("median"), F.max(s).alias("high"), F.avg((s > 0).cast("double")).alias("share_positive"))


def dm_test(oos: DataFrame, lags: int = HAC) -> DataFrame:
    """Diebold-Mariano statistic of the losses of p and clim, with Bartlett weights over ``lags`` autocovariances."""
    d = oos.select(SERIES, "pos", (loss("p") - loss("clim")).alias("d"))
    d = d.withColumn("mean", F.avg("d").over(Window.partitionBy(SERIES))).withColumn("e", F.col("d") - F.col("mean"))
    terms = [F.col("e") * F.col("e")] + [2 * (1 - j / (lags + 1)) * F.col("e") * F.coalesce(F.lag("e", j).over(series()), F.lit(0.0)) for j in range(1, lags + 1)]
    got = d.withColumn("s", sum(terms[1:], terms[0])).groupBy(SERIES).agg(F.count("*").alias("n"), F.first("mean").alias("mean_diff"), F.sum("s").alias("s"))
    return got.select(SERIES, "n", "mean_diff", ratio(F.col("mean_diff"), F.sqrt(F.when(F.col("s") > 0, F.col("s"))) / F.col("n")).alias("t"))


def coverage(oos: DataFrame) -> DataFrame:
    """Share of 20-session returns inside the bands of one, 1.2816 and 1.645 sigmas of rv22, and the left tail's."""
    sigma = F.col("rv22") * F.sqrt(F.lit(vol.H / vol.YEAR))
    lr = F.ln(1 + F.col("fwd_ret_20"))
    inside = lambda z: F.avg((F.abs(lr) <= z * sigma).cast("double"))
    got = oos.dropna(subset=["fwd_ret_20"]).groupBy(SERIES).agg(F.count("*").alias("n"), inside(1.0).alias("in_1s"), inside(1.2816).alias("in_80"), inside(1.645).alias("in_90"), F.avg((lr < -1.645 * sigma).cast("double")).alias("left_tail"))
    low, high = wilson(F.col("in_1s"), F.col("n") / vol.H)
    return got.withColumns({"low_1s": low, "high_1s": high})


def volatility_scores(df: DataFrame, forecasts_of: dict[str, Column], target: str) -> DataFrame:
    """Log errors, QLIKE and log R2 of forecasts of a log volatility, by source and block and over all blocks (block null)."""
    cells = F.array(*(F.struct(F.lit(k).alias("source"), v.alias("f")) for k, v in forecasts_of.items()))
    whole_rows = df.dropna(subset=[target]).withColumn("_all", F.forall(F.array(*forecasts_of.values()), lambda x: x.isNotNull())).filter("_all")
    rows = whole_rows.select(SERIES, "block", F.col(target).alias("z"), F.explode(cells).alias("x")).select(SERIES, "block", "z", "x.source", "x.f")
    e = F.col("z") - F.col("f")
    sets = [[F.col(SERIES), F.col("source"), F.col("block")], [F.col(SERIES), F.col("source")]]
    spread = F.sum(F.col("z") * F.col("z")) - F.sum("z") * F.sum("z") / F.count("*")
    return rows.groupingSets(sets, SERIES, "source", "block").agg(F.count("*").alias("n"), F.avg(e * e).alias("log_mse"), F.avg(F.exp(2 * e) - 2 * e - 1).alias("qlike"), (1 - ratio(F.sum(e * e), spread)).alias("log_r2"))
