"""The two-state model of two observations: filter by refit, one step on, chances ahead, and a table of parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, logit, path_key, path_part
from tidemark.operators import fit, folds

CLIP = 1e-4


def stationary(p00: Column, p11: Column) -> Column:
    """Share of the volatile state in the long run."""
    return (1 - p00) / F.nullif(2 - p00 - p11, F.lit(0.0))


def log_density(k: int) -> Column:
    """Log density of the observations r100 and ln_rv10 in state k, by the parameter columns of ``fit.regimes``."""
    s11, s12, s22 = F.col(f"var_r{k}"), F.col(f"cov_rv{k}"), F.col(f"var_v{k}")
    det = s11 * s22 - s12 * s12
    a, b = F.col("r100") - F.col(f"mean_r{k}"), F.col("ln_rv10") - F.col(f"mean_v{k}")
    q = (s22 * a * a - 2 * s12 * a * b + s11 * b * b) / det
    return F.when(det > 0, F.lit(-math.log(2 * math.pi)) - F.ln(det) / 2 - q / 2)


def segments(df: DataFrame, params: DataFrame) -> DataFrame:
    """df (pos, date, r100, ln_rv10) joined with the parameters of its year, and each state's log density."""
    joined = df.withColumn("year", F.year("date")).join(params.select(SERIES, "year", *fit.REGIME), [SERIES, "year"])
    return joined.withColumns({"l0": log_density(0), "l1": log_density(1)})


def filter_step(held: dict, row: tuple) -> tuple:
    """One session of the filter: predict by the stays, then weigh by the densities, if there are any."""
    l0, l1, p00, p11 = row
    high = (1 - p00) / (2 - p00 - p11) if held["p"] is None else held["p"] * p11 + (1 - held["p"]) * (1 - p00)
    if l0 is None or l1 is None:
        held["p"] = high
        return (None,)
    most = max(l0, l1)
    a, b = high * math.exp(l1 - most), (1 - high) * math.exp(l0 - most)
    held["p"] = a / (a + b)
    return (held["p"],)


def filtered(df: DataFrame, params: DataFrame, p_high: float | None = None) -> DataFrame:
    """Probability of the volatile state given the observations up to each row, each year by its own parameters.

    The state's probability is carried over refits. A row without observations only predicts and gives null. A fold over
    each series: what comes later is never read.
    """

    return folds.fold(segments(df, params), ["l0", "l1", "p00", "p11"], "p_high double", filter_step, {"p": p_high})


def one_step(before: Column) -> Column:
    """The filter's next value from the one before it, on a row of ``segments``: what a daily run is checked against."""
    high = before * F.col("p11") + (1 - before) * (1 - F.col("p00"))
    most = F.greatest("l0", "l1")
    a, b = high * F.exp(F.col("l1") - most), (1 - high) * F.exp(F.col("l0") - most)
    return F.when(F.col("l0").isNotNull() & F.col("l1").isNotNull(), a / (a + b))


def ahead(p: Column, p00: Column, p11: Column, k: int) -> dict[str, Column]:
    """In k sessions: the chance to be in the volatile state, and to be in it at least once until then."""
    share = stationary(p00, p11)
    inside = F.when(p.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    never = inside * (1 - p11) * F.pow(p00, F.lit(k - 1)) + (1 - inside) * F.pow(p00, F.lit(k))
    return {"p_k": share + F.pow(p00 + p11 - 1, F.lit(k)) * (inside - share), "q_k": 1 - never}


def smoothed(df: DataFrame, params: DataFrame, year: int | None = None) -> DataFrame:
    """Probability of the volatile state given all observations of a series, by the parameters of one year (or the only ones).

    It reads the future: for tests of leaks only. A fold forward leaves each row's filtered probability, a fold backward
    over these turns them round; the state of both is one number, whatever the length of a series. Rows without both
    observations stand outside (null).
    """
    own = params.filter(F.col("year") == year) if year is not None else params
    own = own.select(SERIES, *fit.REGIME).distinct()
    rows = df.select(SERIES, "pos", "r100", "ln_rv10").join(own, SERIES).withColumns({"l0": log_density(0), "l1": log_density(1)})
    good = rows.filter("l0 is not null and l1 is not null and not isnan(l0) and not isnan(l1)")
    forward = folds.fold(good, ["l0", "l1", "p00", "p11"], "p_high double", filter_step, {"p": None}).join(own.select(SERIES, "p00", "p11"), SERIES)

    def step(held: dict, row: tuple) -> tuple:
        f, p00, p11 = row
        if held["after"] is not None:
            high = f * p11 + (1 - f) * (1 - p00)
            f *= p11 * held["after"] / high + (1 - p11) * (1 - held["after"]) / (1 - high)
        held["after"] = f
        return (f,)

    back = folds.fold(forward.withColumn("back", -F.col("pos")), ["p_high", "p00", "p11"], "p_smooth double", step, {"after": None}, order="back")
    return rows.select(SERIES, "pos").join(back.select(SERIES, (-F.col("back")).alias("pos"), "p_smooth"), [SERIES, "pos"], "left")


def occupancy(df: DataFrame, params: DataFrame) -> DataFrame:
    """Mean filtered probability of the volatile state by series and year."""
    return filtered(df, params).join(df.select(SERIES, "pos", "date"), [SERIES, "pos"]).groupBy(SERIES, F.year("date").alias("year")).agg(F.count("p_high").alias("n"), F.avg("p_high").alias("share_high"))


def theta_table(params: DataFrame) -> DataFrame:
    """By refit: stay probabilities, expected stays, annual volatilities, drifts and the long-run share of the volatile state."""
    stay = lambda p: 1 / F.nullif(1 - F.col(p), F.lit(0.0))
    sd = lambda k: F.sqrt(f"var_r{k}") / 100 * math.sqrt(YEAR)
    return params.select(SERIES, "year", "p00", "p11", stay("p00").alias("stay0"), stay("p11").alias("stay1"), sd(0).alias("vol0"), sd(1).alias("vol1"), F.col("mean_r0").alias("drift0"), F.col("mean_r1").alias("drift1"), stationary(F.col("p00"), F.col("p11")).alias("share_high"), "kept_prev")


def guard_reasons() -> Column:
    """Why parameters would be refused, as a list; empty if they are sound. On rows of ``fit.regimes`` with share_low and share_high."""
    det = lambda k: F.col(f"var_r{k}") * F.col(f"var_v{k}") - F.pow(F.col(f"cov_rv{k}"), 2)
    rules = {
        "p00": F.col("p00").between(0.90, 0.999), "p11": F.col("p11").between(0.90, 0.999), "gap": F.col("mean_v1") - F.col("mean_v0") >= 0.3, "share_low": F.col("share_low") >= 0.05, "share_high": F.col("share_high") >= 0.05,
        "cov0": det(0) > 0, "cov1": det(1) > 0,
    }
    return F.array_join(F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull()), ",")


def member_probabilities(df: DataFrame, params: DataFrame, labels: DataFrame, ahead_by: int | None = None) -> DataFrame:
    """The regime member: its logit, refit each year to the labels known then, turned into a probability (Platt scaling).

    With ``ahead_by`` the chance to be in the volatile state at least once in so many sessions stands in for that of being in it.

    The filter of each year's parameters gives x over the whole past of that year, so the scaling learns from what those
    parameters say, not from what older ones said at the time.
    """
    years = params.select(SERIES, "year", *fit.REGIME)
    refits = fit.refits(df).select(SERIES, "year", "refit_pos", F.coalesce("next_pos", F.lit(2**31 - 1)).alias("next_pos"))
    # one path for each refit: all rows up to the next refit, under that refit's parameters
    rows = df.join(refits.join(years, [SERIES, "year"]), SERIES).filter(F.col("pos") < F.col("next_pos"))
    paths = rows.withColumns({"l0": log_density(0), "l1": log_density(1), "path": path_key("year", SERIES)})

    p = folds.fold(paths, ["l0", "l1", "p00", "p11"], "p_high double", filter_step, {"p": None}, "path")
    x = p.filter("p_high is not null").select(path_part("path", 0).cast("int").alias("year"), path_part("path", 1).alias(SERIES), "pos", "p_high")
    chance = F.col("p_high")
    if ahead_by is not None:
        x = x.join(years.select(SERIES, "year", "p00", "p11"), [SERIES, "year"])
        chance = ahead(F.col("p_high"), F.col("p00"), F.col("p11"), ahead_by)["q_k"]
    x = x.withColumn("x_hmm", logit(F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), chance)))).select(SERIES, "year", "pos", "p_high", "x_hmm")
    known = x.join(labels.select(SERIES, "pos", "y"), [SERIES, "pos"]).join(refits, [SERIES, "year"])
    coef = fit.logit_by_group(known.filter(F.col("pos") <= F.col("refit_pos") - fit.PURGE - 1).dropna(subset=["y"]), ["x_hmm"])
    own = known.filter(F.col("pos") >= F.col("refit_pos"))
    z = F.col("coef")[0] + F.col("coef")[1] * F.col("x_hmm")
    return own.join(coef, [SERIES, "year"], "left").select(SERIES, "pos", "year", "p_high", "x_hmm", (1 / (1 + F.exp(-z))).alias("m_h"))
