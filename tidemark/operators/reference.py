"""Reference distributions of all panels at once: sketches of quantiles, merged over series, and the rank of a value in them.

Every session contributes its value to each panel; one aggregation makes a KLL sketch for each series and panel, and the
sketches of a panel merge to that of all series, so values are read and shuffled once, as sketches. A sketch of size
SIZE is exact up to SIZE values; beyond them a quantile's rank errs by less than RANK_ERROR with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES

SIZE, RANK_ERROR = 32_768, 0.0002
#: Steps of a looked-up rank.
GRID = 1000
QUANTILES = (0.05, 0.1, 0.5, 0.9, 0.95)


def panels(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """series_id, pos, panel, value: every panel's values, nulls and NaN left out."""
    cells = F.array(*(F.struct(F.lit(n).alias("panel"), v.cast("double").alias("value")) for n, v in values.items()))
    return rows.select(SERIES, "pos", F.explode(cells).alias("x")).select(SERIES, "pos", "x.panel", "x.value").filter("value is not null and not isnan(value)")


def sketches(values: DataFrame, size: int = SIZE) -> DataFrame:
    """series_id (null: all), panel, sketch, n, mean, low, high."""
    each = values.groupBy(SERIES, "panel").agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("low"), F.max("value").alias("high"))
    every = each.groupBy("panel").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))
    both = each.unionByName(every.withColumn(SERIES, F.lit(None).cast(dict(values.dtypes)[SERIES])))
    return both.withColumn("mean", F.col("sum") / F.col("n")).drop("sum")


def quantiles(found: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The sketches' figures: the least value that so large a share of values doesn't exceed."""
    q = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(x)).alias(f"p{round(100 * x):02d}")
    return found.select(SERIES, "panel", "n", "mean", "low", "high", *(q(x) for x in at))


def ranks(live: DataFrame, found: DataFrame, grid: int = GRID) -> DataFrame:
    """live (series_id, panel, value) with the share of past values, of its own series and of all, that aren't above, in steps of 1 / grid.

    A sketch gives the quantiles at all steps at once; the rank is the number of them that the value reaches.
    """
    steps = F.array(*(F.lit(i / grid) for i in range(1, grid + 1)))
    marks = found.select(SERIES, "panel", F.kll_sketch_get_quantile_double("sketch", steps).alias("marks"))
    own = marks.filter(F.col(SERIES).isNotNull())
    every = marks.filter(F.col(SERIES).isNull()).select("panel", F.col("marks").alias("all_marks"))
    met = live.join(own, [SERIES, "panel"]).join(every, "panel")
    rank = lambda c: F.size(F.filter(c, lambda x: x <= F.col("value"))) / grid
    return met.select(SERIES, "panel", "value", rank("marks").alias("own_rank"), rank("all_marks").alias("all_rank"))
