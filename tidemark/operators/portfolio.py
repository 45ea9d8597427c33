"""Exposure targets, their variants, and the tables that judge a path of weights."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, clip, path_key, path_part, series, trailing
from tidemark.operators import folds, paths

#: Exposures, grids, budget lines, bounds of the six conditions.
W_MIN, W_MAX, GRID, BAND = 0.25, 1.0, 0.05, 0.10
VOL_GRID, K_SLOW, K_FAST = (0.06, 0.08, 0.10, 0.12, 0.15), 3.5, 2.0
MULTIPLIER = {"normal": 1.0, "caution": 0.5, "reduce": 0.25}
MILD = {"normal": 1.0, "caution": 0.75, "reduce": 0.5}
TONE = {"normal": "hold", "caution": "caution", "reduce": "reduce"}
EPS, NARROW = 1e-9, 0.01
BOUNDS = {"max_dd": 2.5, "improvement": 0.05, "switches": 24.0, "cost": 0.05, "month": 0.02, "ratio": (0.75, 1.15)}


def on_grid(w: Column, grid: float) -> Column:
    """w rounded half to even on a grid."""
    return F.round(F.bround(w / grid) * grid, 10)


def target_vol(spark: SparkSession, budgets: DataFrame, k: float = K_SLOW) -> DataFrame:
    """budgets (d_max) with the largest volatility of the grid that d_max / k allows; null if none does."""
    allowed = F.filter(F.array(*map(F.lit, VOL_GRID)), lambda g: g <= F.col("d_max") / k + EPS)
    return budgets.withColumn("sigma_target", F.array_max(allowed))


def budget_ladder(spark: SparkSession, results: DataFrame | None = None) -> DataFrame:
    """The grid of target volatilities with its slow and fast drawdown lines, and the results (sigma_target and others)."""
    g = spark.createDataFrame([(x,) for x in VOL_GRID], "sigma_target double")
    g = g.withColumns({"d_slow": F.round(K_SLOW * F.col("sigma_target"), 10), "d_fast": F.round(K_FAST * F.col("sigma_target"), 10)})
    return g if results is None else g.join(results, "sigma_target", "left")


def mapped(state: Column, table: dict) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(state == name, value) if out is None else out.when(state == name, value)
    return out


def exposure(sigma: Column, mult: Column, target: float | Column, floor_after: bool = True) -> dict[str, Column]:
    """w_vol, target volatility over the forecast, and w_target, times the multiplier; null where sigma isn't positive."""
    w_vol = F.when(sigma > 0, clip(target / sigma, W_MIN, W_MAX))
    return {"w_vol": w_vol, "w_target": clip(w_vol * mult, W_MIN, W_MAX) if floor_after else w_vol * mult}


def thresholds(w: Column, target: float, mult: Column, band: float = BAND) -> dict[str, Column]:
    """Volatilities at which the next step down and up would come; null where floor or ceiling forbid it."""
    low, high = w - band, w + band
    ceiling = F.greatest(F.lit(W_MIN), W_MAX * mult)
    return {"sigma_down": F.when(low >= W_MIN - EPS, target * mult / low), "sigma_up": F.when(high <= ceiling + EPS, target * mult / high)}


def decision_thresholds(state: Column, days: Column, clim: Column, cfg: folds.DecisionConfig) -> dict[str, Column]:
    """Ratios and probabilities of the next step up and down from a state, and the sessions it must still stay."""
    up = mapped(state, {"normal": cfg.enter_caution, "caution": cfg.enter_reduce})
    down = mapped(state, {"caution": cfg.exit_caution, "reduce": cfg.exit_reduce})
    return {"r_up": up, "p_up": up * clim, "r_down": down, "p_down": down * clim, "dwell_left": F.when(down.isNotNull(), F.greatest(F.lit(0), cfg.dwell - days))}


def most_changes(cfg: folds.DecisionConfig, window: int = 5) -> int:
    """How often the state machine can change in a window at most: by trying all paths of representative ratios.

    A ratio counts only by where it lies between the four thresholds, and longer stays than the dwell act alike, so a
    few thousand paths on the driver are all there are, whatever the data.
    """
    levels = sorted({0.0, (cfg.exit_caution + cfg.enter_caution) / 2, (cfg.enter_caution + cfg.exit_reduce) / 2 if cfg.enter_caution < cfg.exit_reduce else cfg.enter_caution, (cfg.exit_reduce + cfg.enter_reduce) / 2, cfg.enter_reduce + 1e-6})
    most = 0
    for state, days in product(MULTIPLIER, range(max(cfg.dwell, cfg.dwell_escalate) + 1)):
        for path in product(levels, repeat=window):
            s, d, n = state, days, 0
            for r in path:
                before = s
                s, d = folds.decide(r, s, d, cfg)
                n += s != before
            most = max(most, n)
    return most


#: name: (weight from, multiplier, grid, band, when it is checked, whether cuts are at once, target volatility or None for the base's)
VARIANTS = {
    "base": ("floored", "mult", GRID, BAND, "week_end", True, None),
    "nofloor": ("product", "mult", GRID, BAND, "week_end", True, None),
    "volonly": ("vol", "one", GRID, BAND, "week_end", True, None),
    "monthly": ("floored", "mult", GRID, BAND, "month_or_change", True, None),
    "mild": ("mild", "mild", GRID, BAND, "month_or_mild", True, None),
    "grid": ("vol", "one", 0.25, 0.125, "month_end", True, None),
    "grid_min": ("least", "mult", 0.25, 0.125, "month_end", True, None),
    "vt14": ("vol", "one", 0.25, 0.125, "month_end", True, 0.14),
    "noesc": ("product", "mult", GRID, BAND, "week_end", False, None),
    "daily": ("product", "mult", GRID, GRID, "daily", True, None),
    "vt7.5": ("product", "mult", GRID, BAND, "week_end", True, 0.075),
    "vt12.5": ("product", "mult", GRID, BAND, "week_end", True, 0.125),
    "vt15": ("product", "mult", GRID, BAND, "week_end", True, 0.15),
    "har": ("har", "mult", GRID, BAND, "week_end", True, None),
}


def variants(df: DataFrame, target: float = 0.10) -> DataFrame:
    """Weights of the base rule and its 15 variants: series_id, variant, pos, w_exec, reason.

    df: pos, sigma, sigma_har, state, week_end, month_end. All variants are one exploded frame and one fold keyed by
    variant and series. ``lag`` is nofloor a session later, ``10bp`` is nofloor at another cost.
    """
    change = lambda c: ~F.coalesce(F.col(c).eqNullSafe(F.lag(c).over(series())), F.lit(False)) | (F.row_number().over(series()) == 1)
    d = df.withColumns({"mult": mapped(F.col("state"), MULTIPLIER), "mild": mapped(F.col("state"), MILD), "one": F.lit(1.0), "daily": F.lit(True)})
    d = d.withColumns({"month_or_change": F.col("month_end") | change("mult"), "month_or_mild": F.col("month_end") | change("mild")})
    options = []
    for name, (kind, mult, grid, band, check, at_once, own) in VARIANTS.items():
        w = exposure(F.col("sigma_har" if kind == "har" else "sigma"), F.lit(1.0), own or target)["w_vol"]
        goal = {
            "floored": clip(w * F.col("mult"), W_MIN, W_MAX), "product": w * F.col("mult"), "vol": w, "mild": clip(w * F.col("mild"), W_MIN, W_MAX),
            "least": F.when(w.isNotNull() & F.col("mult").isNotNull(), F.least(w, F.col("mult"))), "har": w * F.col("mult"),
        }[kind]
        options.append(F.struct(F.lit(name).alias("variant"), goal.alias("w_target"), F.col(mult).alias("mult"), F.lit(grid).alias("grid"), F.lit(band).alias("band"), F.col(check).alias("check"), F.lit(at_once).alias("at_once")))
    rows = d.select(SERIES, "pos", F.explode(F.array(*options)).alias("v")).select(SERIES, "pos", "v.*").withColumn("path", path_key("variant", SERIES))
    done = folds.sizing_rules(rows).withColumns({"variant": path_part("path", 0), SERIES: path_part("path", 1)}).select(SERIES, "variant", "pos", "w_exec", "reason")
    late = done.withColumn("late", F.lag("w_exec").over(Window.partitionBy(SERIES, "variant").orderBy("pos")))
    more = lambda name, w: F.struct(F.lit(name).alias("variant"), F.col(w).alias("w_exec"))
    own = F.struct("variant", "w_exec")
    each = F.explode(F.when(F.col("variant") == "nofloor", F.array(own, more("lag", "late"), more("10bp", "w_exec"))).otherwise(F.array(own)))
    return late.select(SERIES, "pos", "reason", each.alias("v")).select(SERIES, "v.variant", "pos", "v.w_exec", "reason")


def backtest(weights: DataFrame, closes: DataFrame, windows: DataFrame, costs: dict[str, float], cost: float = 5.0, target: float = 0.10) -> DataFrame:
    """Performance by path, window and series. weights: series_id, variant, pos, w; windows: name, first and last date.

    The weight of the session before earns a session's return within a window; the hold path has weight 1 and no cost.
    """
    hold = closes.select(SERIES, F.lit("hold").alias("variant"), "pos", F.lit(1.0).alias("w"))
    every = weights.select(SERIES, "variant", "pos", "w").filter("w is not null").unionByName(hold)
    # windows are few
    met = every.join(closes.select(SERIES, "pos", "date", "close"), [SERIES, "pos"]).join(F.broadcast(windows), F.col("date").between(F.col("first"), F.col("last")))
    path = path_key("variant", "name", SERIES)
    d = met.select(path.alias(SERIES), "date", "pos", "close", "w", F.coalesce(mapped(F.col("variant"), {**costs, "hold": 0.0}), F.lit(cost)).alias("bps"))
    before, at_all = F.lag("w").over(series()), F.lag("close").over(series())
    moved = F.abs(F.coalesce(before - F.lag("w", 2).over(series()), F.lit(0.0)))
    d = d.withColumns({"spent": F.col("bps") / 10_000 * moved, "moved": (moved > 1e-12).cast("int"), "before": before, "ret": F.col("close") / at_all - 1})
    d = d.withColumn("rule_ret", (1 + F.col("before") * F.col("ret")) * (1 - F.col("spent")) - 1).filter("rule_ret is not null")
    perf = paths.performance(d, "rule_ret")
    more = d.groupBy(SERIES).agg(F.avg("before").alias("avg_exposure"), F.sum("spent").alias("cost_total"), F.sum("moved").alias("n_switches"), (F.sum("moved") * YEAR / F.count("*")).alias("switches_a_year"))
    got = perf.join(more, SERIES).select(F.from_json(SERIES, "array<string>").alias("k"), "*").drop(SERIES)
    got = got.select(F.col("k")[0].alias("variant"), F.col("k")[1].alias("window"), F.col("k")[2].alias(SERIES), *(c for c in got.columns if c != "k"))
    held = lambda c: F.max(F.when(F.col("variant") == "hold", F.col(c))).over(Window.partitionBy(SERIES, "window"))
    return got.withColumns({"cagr_over_hold": F.col("cagr") - held("cagr"), "dd_over_hold": F.col("max_dd") - held("max_dd"), "vol_ratio": F.col("ann_vol") / target, "dd_ratio": F.abs("max_dd") / target})


def retention(table: DataFrame, target: float, adopted: str, vol_only: str, reference: str, window: str, vol_window: str) -> DataFrame:
    """Six conditions (a to f) on rows of the backtest table by series: value, limit, verdict (null if a row is missing), narrow."""
    row = lambda name, w, p: [F.max(F.when((F.col("variant") == name) & (F.col("window") == w), F.col(c))).alias(f"{p}_{c}") for c in ("max_dd", "switches_a_year", "cost_total", "ann_vol", "worst_month")]
    d = table.groupBy(SERIES).agg(*row(adopted, window, "a"), *row(vol_only, vol_window, "v"), *row(reference, window, "r"))
    c, b = F.col, BOUNDS
    ratio = c("a_ann_vol") / target
    rows = {
        "a": (c("a_max_dd"), F.lit(-b["max_dd"] * target), c("a_max_dd") + b["max_dd"] * target),
        "b": (c("v_max_dd"), F.lit(-K_SLOW * target), c("v_max_dd") + K_SLOW * target),
        "c": (c("a_max_dd") - c("r_max_dd"), F.lit(b["improvement"]), c("a_max_dd") - c("r_max_dd") - b["improvement"]),
        "d": (c("a_switches_a_year"), F.lit(b["switches"]), F.when(c("a_cost_total").isNotNull() & c("a_switches_a_year").isNotNull(), F.when((c("a_switches_a_year") <= b["switches"]) & (c("a_cost_total") <= b["cost"]), 1.0).otherwise(-1.0))),
        "e": (c("a_worst_month") - c("r_worst_month"), F.lit(-b["month"]), c("a_worst_month") - c("r_worst_month") + b["month"]),
        "f": (ratio, F.lit(b["ratio"][1]), F.when(ratio.isNotNull(), F.least(ratio - b["ratio"][0], b["ratio"][1] - ratio))),
    }
    cells = F.array(*(F.struct(F.lit(k).alias("condition"), v.alias("value"), limit.alias("limit"), margin.alias("margin")) for k, (v, limit, margin) in rows.items()))
    return d.select(SERIES, F.explode(cells).alias("x")).select(SERIES, "x.condition", "x.value", "x.limit", (F.col("x.margin") >= 0).alias("passed"), ((F.col("x.margin") >= 0) & (F.col("x.margin") < NARROW)).alias("narrow"))


def deploys(conditions: DataFrame) -> DataFrame:
    """Whether all six conditions passed, and which failed or are undecided."""
    listed = lambda when: F.array_join(F.sort_array(F.collect_list(F.when(when, F.col("condition")))), ",")
    return conditions.groupBy(SERIES).agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("deploy"), listed(~F.col("passed")).alias("failed"), listed(F.col("passed").isNull()).alias("undecided"))


def kpis(decided: DataFrame) -> DataFrame:
    """Occupancy, drawdown rates, runs, alarms and changes of decided states by series. decided: pos, state, changed, churn_252, y, r."""
    d = decided.withColumn("in_5", F.sum(F.col("changed").cast("long")).over(trailing(5)))
    share = lambda s: F.avg((F.col("state") == s).cast("double")).alias(f"share_{s}")
    rate = lambda s: F.avg(F.when(F.col("state") == s, F.col("y"))).alias(f"dd_{s}")
    got = d.groupBy(SERIES).agg(
        F.count("*").alias("n"), F.sum(F.col("changed").cast("long")).alias("changes"), *map(share, MULTIPLIER), *map(rate, MULTIPLIER), F.avg("y").alias("base_rate"), F.max("in_5").alias("most_in_5"), F.max("churn_252").alias("most_churn"),
        F.count_if(F.col("churn_252") > 12).alias("churn_alerts"), F.count_if(F.col("r").isNull()).alias("n_missing"),
    )
    runs = paths.run_lengths(decided, "state").groupBy(SERIES).agg(*(F.percentile(F.when(F.col("state") == s, F.col("length")), 0.5).alias(f"run_{s}") for s in MULTIPLIER))
    return got.withColumn("changes_a_year", F.col("changes") * YEAR / F.col("n")).join(runs, SERIES)
