"""The kill rule replayed at every 21st session of the past: how often it would have dropped a model that has skill.

Each start opens a window of MONTHS; a window's skill is one minus the ratio of two losses. Losses are summed once as
prefix sums, so a window costs two lookups, and so do the nulls: noise of the model's own spread round the climatology,
and the model's own forecasts with its blocks shuffled. Draws are digests of seed, series and place, not a generator's
state, so they are the same in any order of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, clip
from tidemark.operators import bootstrap

#: Months of a window, rows of a block, rows between starts, falls that the rule waits for, windows with an interval and its draws, shuffles.
MONTHS, BLOCK, STEP, EPISODES = 36, 40, 21, 8
PICKED, DRAWS, SHUFFLES = 75, 1_000, 20


def numbered(oos: DataFrame, p: str, y: str, ref: str) -> DataFrame:
    """series_id, k (from 0), date, p, y, ref, lp, lr of the rows that can be scored, in the order of dates."""
    d = oos.select(SERIES, "date", F.col(p).alias("p"), F.col(y).cast("double").alias("y"), F.col(ref).alias("ref")).dropna()
    k = F.row_number().over(Window.partitionBy(SERIES).orderBy("date")) - 1
    return d.select(SERIES, k.cast("long").alias("k"), "date", "p", "y", "ref", F.pow(F.col("p") - F.col("y"), 2).alias("lp"), F.pow(F.col("ref") - F.col("y"), 2).alias("lr"))


def counted_before(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """asked (series_id, date and any others) with the number of rows of its series before its date: one sorted pass, no range join."""
    extra = [c for c in asked.columns if c not in (SERIES, "date")]
    kinds = dict(asked.dtypes)
    both = asked.select(SERIES, "date", F.lit(0).alias("_row"), *extra).unionByName(rows.select(SERIES, "date", F.lit(1).alias("_row"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra)))
    before = F.coalesce(F.sum("_row").over(Window.partitionBy(SERIES).orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return both.withColumn(name, before).filter("_row = 0").drop("_row")


def windows(rows: DataFrame, months: int = MONTHS, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """series_id, w (from 0), s, e, start: rows s to e - 1 of each window that is over, one from every ``step``-th row."""
    last = F.max("date").over(Window.partitionBy(SERIES))
    starts = rows.withColumn("last", last).filter(F.col("k") % step == 0).select(SERIES, F.add_months("date", months).alias("date"), F.col("k").alias("s"), F.col("date").alias("start"), "last").filter(F.col("date") <= F.col("last")).drop("last")
    found = counted_before(rows, starts, "e").filter(F.col("e") - F.col("s") >= block)
    w = F.row_number().over(Window.partitionBy(SERIES).orderBy("s")) - 1
    return found.select(SERIES, w.cast("long").alias("w"), "s", F.col("e").cast("long").alias("e"), "start")


def skills(losses: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """skill of each span (series_id, w, s, e) in each group of losses (series_id, by, k, lp, lr): two lookups in prefix sums."""
    upto = Window.partitionBy(SERIES, *by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = losses.select(SERIES, *by, "k", F.sum("lp").over(upto).alias("lp"), F.sum("lr").over(upto).alias("lr"))
    at = lambda edge: spans.select(SERIES, "w", (F.col(edge) - 1).alias("k")).join(sums, [SERIES, "k"]).select(SERIES, "w", *by, F.col("lp").alias(f"lp_{edge}"), F.col("lr").alias(f"lr_{edge}"))
    both = at("e").join(at("s"), [SERIES, "w", *by], "left")  # nothing stands before the first row
    diff = lambda c: F.col(f"{c}_e") - F.coalesce(f"{c}_s", F.lit(0.0))
    return both.select(SERIES, "w", *by, F.when(diff("lr") > 0, 1 - diff("lp") / diff("lr")).alias("skill"))


def normal(seed: str, *parts: str) -> Column:
    """A normal draw from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - bootstrap.uniform(F.lit(f"{seed}a"), *parts))) * F.cos(2 * math.pi * bootstrap.uniform(F.lit(f"{seed}b"), *parts))


def noise(rows: DataFrame, seed: str = "noise") -> DataFrame:
    """Losses of the climatology with noise of the spread of p around it."""
    sd = F.stddev_samp(F.col("p") - F.col("ref")).over(Window.partitionBy(SERIES))
    p = clip(F.col("ref") + sd * normal(seed, SERIES, "k"), 1e-6, 1 - 1e-6)
    return rows.select(SERIES, "k", F.pow(p - F.col("y"), 2).alias("lp"), "lr")


def shuffled(rows: DataFrame, shuffles: int = SHUFFLES, block: int = BLOCK, seed: str = "shuffle") -> DataFrame:
    """Losses of p with its blocks in another order, for each shuffle; the last block may be short wherever it comes."""
    cut = rows.select(SERIES, F.floor(F.col("k") / block).alias("block"), "k", "p")
    sizes = cut.groupBy(SERIES, "block").agg(F.count("*").alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"))
    order = Window.partitionBy(SERIES, "shuffle").orderBy(bootstrap.uniform(F.lit(seed), SERIES, "shuffle", "block"), "block")
    begins = sizes.withColumn("begin", F.sum("size").over(order) - F.col("size"))
    moved = cut.join(begins, [SERIES, "block"]).select(SERIES, "shuffle", (F.col("begin") + F.col("k") % block).alias("k"), "p")
    return moved.join(rows.select(SERIES, "k", "y", "lr"), [SERIES, "k"]).select(SERIES, "shuffle", "k", F.pow(F.col("p") - F.col("y"), 2).alias("lp"), "lr")


def picked(spans: DataFrame, most: int = PICKED) -> DataFrame:
    """At most so many spans of each series, at even distances."""
    n = spans.groupBy(SERIES).agg(F.count("*").alias("n")).withColumn("m", F.least("n", F.lit(most)))
    at = n.select(SERIES, "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    places = at.select(SERIES, F.when(F.col("m") > 1, F.bround(F.col("j") * (F.col("n") - 1) / (F.col("m") - 1))).otherwise(0).cast("long").alias("w")).distinct()
    return spans.join(places, [SERIES, "w"])


def months_between_dates(start: str, end: str) -> Column:
    """Calendar months from one date to another, whatever their days."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def months_to_episodes(spans: DataFrame, breaches: DataFrame, needed: int = EPISODES) -> DataFrame:
    """series_id, w and the months from a span's start to the ``needed``-th breach (series_id, date) from then on; null if it hasn't come."""
    asked = counted_before(breaches, spans.select(SERIES, F.col("start").alias("date"), "w"), "before")
    ranked = breaches.select(SERIES, F.col("date").alias("end"), F.row_number().over(Window.partitionBy(SERIES).orderBy("date")).cast("long").alias("rank"))
    met = asked.withColumn("rank", (F.col("before") + needed).cast("long")).join(ranked, [SERIES, "rank"], "left")
    return met.select(SERIES, "w", months_between_dates("date", "end").alias("months"))


def replayed(oos: DataFrame, breaches: DataFrame | None = None, p: str = "p", y: str = "y", ref: str = "clim", picks: int = PICKED, draws: int = DRAWS, shuffles: int = SHUFFLES) -> DataFrame:
    """By series: windows, the share that the rule would have killed, quantiles of their skill, the share with an interval
    above zero, the shares of both nulls that pass, the spread of the noise, and months until the eighth fall."""
    rows = numbered(oos, p, y, ref)
    spans = windows(rows)
    q = lambda c, x: F.percentile(c, x)
    true = skills(rows, spans, []).dropna()
    out = true.groupBy(SERIES).agg(F.count("*").alias("n_windows"), F.avg((F.col("skill") <= 0).cast("double")).alias("false_kill_share"), *(q("skill", x / 100).alias(f"skill_p{x}") for x in (10, 50, 90)), F.avg("skill").alias("skill_mean"))
    some = picked(spans, picks).select(SERIES, "w", F.explode(F.sequence("s", F.col("e") - 1)).alias("k"))
    bounds = bootstrap.interval(some.join(rows.select(SERIES, "k", "lp", "lr"), [SERIES, "k"]), "lp", [SERIES, "w"], BLOCK, draws, 0, "lr", "k").dropna(subset=["low"])
    out = out.join(bounds.groupBy(SERIES).agg(F.count("*").alias("ci_windows"), F.avg((F.col("low") > 0).cast("double")).alias("validated_share")), SERIES, "left")
    passes = F.avg((F.col("skill") > 0).cast("double"))
    by_noise = skills(noise(rows), spans, []).dropna().groupBy(SERIES).agg(passes.alias("noise_pass"))
    by_shuffle = skills(shuffled(rows, shuffles), spans, ["shuffle"]).dropna().groupBy(SERIES, "shuffle").agg(passes.alias("x")).groupBy(SERIES).agg(F.avg("x").alias("shuffle_pass"))
    out = out.join(by_noise, SERIES, "left").join(by_shuffle, SERIES, "left").withColumn("power", 1 - F.col("shuffle_pass"))
    if breaches is None:
        return out
    months = months_to_episodes(spans, breaches).groupBy(SERIES).agg(F.count("months").alias("reached"), (F.count("*") - F.count("months")).alias("censored"), *(q("months", x / 100).alias(f"months_p{x}") for x in (10, 50, 90)))
    return out.join(months, SERIES, "left")
