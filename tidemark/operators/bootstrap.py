"""Circular block bootstrap as joins: block sums once, keyed draws of blocks, sums by draw.

A resample of n rows is a run of blocks that begin at drawn places and go round the end; the last one is cut so that n
rows come out. What a block adds is the difference of two prefix sums, so a draw costs a lookup a block, whatever the
block's length, and the draws of one group spread over all tasks. Draws are numbers from a digest of (seed, draw, block):
any engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 52


def uniform(seed: int | Column, *parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of seed:part:part..."""
    text = F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("double") / float(1 << BITS)


def block_sums(df: DataFrame, values: list[str], by: list[str], block: int, order: str = "pos") -> DataFrame:
    """by, n, start, and for each value <v>_full and <v>_tail: sums of the block that starts at a row and of the last, cut one."""
    w = Window.partitionBy(*by)
    d = df.select(*by, *values, (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("start"), F.count("*").over(w).alias("n"))
    # the first rows once more after the end: blocks go round; a group shorter than a block goes round several times
    turns = F.sequence(F.lit(0), F.ceil(F.lit(float(block)) / F.col("n")).cast("int"))
    d = d.withColumn("turn", F.explode(turns)).withColumn("start", F.col("start") + F.col("turn") * F.col("n")).filter(F.col("start") <= F.col("n") + block)
    before = w.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(*by, "n", "start", *(F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(v) for v in values))
    tail = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block
    at = lambda name, k: d.select(*by, (F.col("start") - k).alias("start"), *(F.col(v).alias(f"{v}_{name}") for v in values))
    both = d.filter(F.col("start") < F.col("n")).join(at("full", F.lit(block)), [*by, "start"]).join(at("tail", tail), [*by, "start"])
    return both.select(*by, "n", "start", *((F.col(f"{v}_{x}") - F.col(v)).alias(f"{v}_{x}") for v in values for x in ("full", "tail")))


def resampled(df: DataFrame, values: list[str], by: list[str], block: int, draws: int, seed: int = 0, order: str = "pos") -> DataFrame:
    """by, n, draw and the sums of the values in each resample."""
    sums = block_sums(df, values, by, block, order)
    blocks = F.ceil(F.col("n") / block).cast("int")
    groups = df.groupBy(*by).agg(F.count("*").alias("n"))
    starts = groups.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    starts = starts.select(*by, "draw", (F.col("i") == blocks - 1).alias("last"), F.floor(uniform(seed, "draw", "i") * F.col("n")).alias("start"))
    of = lambda v: F.sum(F.when(F.col("last"), F.col(f"{v}_tail")).otherwise(F.col(f"{v}_full")))
    # draws multiply rows, which Spark's estimate doesn't see: unhinted, it would broadcast them through the driver
    return starts.join(sums.hint("shuffle_hash"), [*by, "start"]).groupBy(*by, "n", "draw").agg(*(of(v).alias(v) for v in values))


def interval(df: DataFrame, value: str, by: list[str], block: int = 40, draws: int = 4_000, seed: int = 0, ratio_to: str | None = None, order: str = "pos") -> DataFrame:
    """by, n, estimate, low, high: the mean of a column, or 1 - mean / mean of ``ratio_to``, with its 95 % interval."""
    values = [value] + ([ratio_to] if ratio_to else [])
    d = df.dropna(subset=values).select(*by, order, *values)
    if ratio_to:
        whole, one = 1 - F.avg(value) / F.nullif(F.avg(ratio_to), F.lit(0.0)), 1 - F.col(value) / F.nullif(F.col(ratio_to), F.lit(0.0))
    else:
        whole, one = F.avg(value), F.col(value) / F.col("n")
    estimate = d.groupBy(*by).agg(F.count("*").alias("n"), whole.alias("estimate"))
    bounds = resampled(d, values, by, block, draws, seed, order).withColumn("x", one).groupBy(*by).agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
    return estimate.join(bounds, by)
