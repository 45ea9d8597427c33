"""Why a probability is what it is and why it moved: terms as arrays of columns, exact sums, no loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, series, sigmoid

#: Refits beside the current parameters that a band spans.
BAND_REFITS = 5
TANGENT = 1e-12


def input_status(names: list[str]) -> dict[str, Column]:
    """Whether all inputs are there, and which aren't."""
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(n).isNull() | F.isnan(n), F.lit(n)) for n in names)), lambda x: x.isNotNull()), ",")
    return {"input_ok": missing == "", "input_missing": missing}


def contributions(df: DataFrame, names: list[str], coef: str = "coef") -> DataFrame:
    """A row for each term of each row of df (series_id, pos, coef, names): its logit and the points that it adds in order.

    Points of a term are the probability with all terms up to it less that without it, so they sum to the probability.
    """
    terms = F.array(F.col(coef)[0], *(F.col(coef)[i + 1] * F.col(n) for i, n in enumerate(names)))
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(names) + 1)), lambda k: F.aggregate(F.slice("terms", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    labels = F.array(*(F.lit(n) for n in ("intercept", *names)))
    d = df.withColumn("terms", terms).withColumn("p_upto", F.transform(upto, sigmoid))
    pp = F.transform(F.col("p_upto"), lambda p, i: p - F.when(i > 0, F.get(F.col("p_upto"), i - 1)).otherwise(F.lit(0.0)))
    rows = d.select(SERIES, "pos", F.explode(F.arrays_zip(labels.alias("term"), F.col("terms").alias("logit"), pp.alias("pp"))).alias("x"))
    return rows.select(SERIES, "pos", "x.term", "x.logit", "x.pp")


def day_over_day(df: DataFrame, names: list[str], coef: str = "coef") -> DataFrame:
    """Changes from the row before: a logit and points for each input and for the refit; the points sum to the change.

    The slope of the secant turns logits into points, that of the tangent where the logit hardly moved.
    """
    before = lambda c: F.lag(c).over(series())
    d = df.withColumns({f"_{n}": before(n) for n in names} | {"_coef": before(coef), "gap": F.col("pos") - before("pos")}).filter("_coef is not null")
    z = lambda c, x: c[0] + sum(c[i + 1] * x(n) for i, n in enumerate(names))
    now, was = lambda n: F.col(n), lambda n: F.col(f"_{n}")
    d = d.withColumns({"z_now": z(F.col(coef), now), "z_prev": z(F.col("_coef"), was)})
    d = d.withColumns({"p_now": sigmoid(F.col("z_now")), "p_prev": sigmoid(F.col("z_prev"))})
    moved = F.col("z_now") - F.col("z_prev")
    slope = F.when(F.abs(moved) < TANGENT, F.col("p_now") * (1 - F.col("p_now"))).otherwise((F.col("p_now") - F.col("p_prev")) / F.nullif(moved, F.lit(0.0)))
    refit = F.col(coef) != F.col("_coef")
    change = F.when(refit, z(F.col(coef), was) - F.col("z_prev")).otherwise(F.lit(0.0))
    parts = F.array(*(F.struct(F.lit(n).alias("term"), (F.col(coef)[i + 1] * (F.col(n) - F.col(f"_{n}"))).alias("d_logit")) for i, n in enumerate(names)), F.struct(F.lit("refit").alias("term"), change.alias("d_logit")))
    rows = d.select(SERIES, "pos", "gap", "p_now", "p_prev", refit.alias("refit"), slope.alias("slope"), F.explode(parts).alias("x"))
    return rows.select(SERIES, "pos", "gap", "p_now", "p_prev", "refit", "x.term", "x.d_logit", (F.col("slope") * F.col("x.d_logit")).alias("d_pp"))


def parameter_band(df: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """df (with year and coef, its own parameters) with the least and largest probability by its own and the BAND_REFITS refits before."""
    recent = params.select(SERIES, F.col("year").alias("refit"), F.col("coef").alias("other"))
    met = df.join(recent, SERIES).filter((F.col("refit") <= F.col("year")) & (F.col("refit") >= F.col("year") - BAND_REFITS))
    p = sigmoid(F.col("other")[0] + sum(F.col("other")[i + 1] * F.col(n) for i, n in enumerate(names)))
    return met.groupBy(SERIES, "pos").agg(F.min(p).alias("p_low"), F.max(p).alias("p_high"), F.count("*").alias("models"))
