"""Live rows against backtests: gates, scores, alarms, stages, outcomes of weights, and rows checked before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, ahead, full, ratio, series, trailing
from tidemark.operators import bootstrap, fit, scoring

HOLDOUT, DIV, BLOCK = "2024-09-01", 20, 40
STAGES = ("0-3m", "6m", "12m", "36m")
#: What a stage hides, allowed values of columns, bounds of the checks.
HIDDEN = {"0-3m": ("bss", "auc", "hist_pct", "verdict"), "6m": ("bss", "auc", "verdict"), "12m": ("verdict",), "36m": ()}
TONES, MODES, STATES = ("buy", "hold", "neutral", "caution", "reduce"), ("tones", "info_only"), ("normal", "caution", "reduce")
OUT_OF_RANGE_DAYS = 5


def gated(df: DataFrame, unlocked: bool, date: str = "date") -> DataFrame:
    """Rows before the held-out time, or all once it is unlocked."""
    return df if unlocked else df.filter(F.col(date) < F.lit(HOLDOUT).cast("date"))


def live_start(ledger: DataFrame, column: str, mode: str | None = None) -> DataFrame:
    """First day by series with a value in the column, and with mode "tones" where a mode column is named."""
    ok = F.col(column).isNotNull() & (F.lit(True) if mode is None else F.coalesce(F.col(mode) == "tones", F.lit(False)))
    return ledger.groupBy(SERIES).agg(F.min(F.when(ok, F.col("asof"))).alias("live_start"))


def effective_mode(p2: Column, p3: Column, killed: Column) -> Column:
    return F.when((p2 == "tones") & (p3 == "tones") & ~F.coalesce(killed, F.lit(False)), "tones").otherwise("info_only")


def stage(n_eff: Column, months: Column) -> Column:
    """What a live record may show by its effective rows and months."""
    n, m = F.coalesce(n_eff, F.lit(0.0)), F.coalesce(months, F.lit(0))
    return F.when((n < 6) | (m < 6), STAGES[0]).when((n < 12) | (m < 12), STAGES[1]).when(m < 36, STAGES[2]).otherwise(STAGES[3])


def may_show(stage_column: Column, key: str) -> Column:
    return ~stage_column.isin(*(s for s in STAGES if key in HIDDEN[s]))


def redacted(df: DataFrame, stage_column: str, keys: dict[str, str]) -> DataFrame:
    """df with columns made null that the stage hides, and their names. keys: column -> what it shows."""
    hidden = F.array_join(F.filter(F.array(*(F.when(~may_show(F.col(stage_column), k), F.lit(c)) for c, k in keys.items())), lambda x: x.isNotNull()), ",")
    return df.withColumns({c: F.when(may_show(F.col(stage_column), k), F.col(c)) for c, k in keys.items()} | {"hidden": hidden})


def score(rows: DataFrame, p: str, references: list[str], y: str = "y", draws: int = 4_000) -> DataFrame:
    """Brier score and skill of p against each reference on the rows that have both, by series, with the first's interval.

    The interval needs BLOCK rows: a circular bootstrap of fewer draws the same rows again and again.
    """
    d = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("lp", F.pow(F.col(p) - F.col(y), 2))
    aggs = [F.count("*").alias("n"), (F.count("*") / DIV).alias("n_eff"), F.avg("lp").alias("brier"), F.avg(y).alias("base_rate"), F.avg(p).alias("mean_p")]
    for r in references:
        both = F.col(r).isNotNull()
        loss = F.pow(F.col(r) - F.col(y), 2)
        aggs += [F.count(r).alias(f"n_{r}"), (1 - ratio(F.avg(F.when(both, F.col("lp"))), F.avg(loss))).alias(f"skill_{r}")]
    got = d.groupBy(SERIES).agg(*aggs)
    first = references[0]
    pairs = d.withColumn("lr", F.pow(F.col(first) - F.col(y), 2))
    boot = bootstrap.interval(pairs, "lp", [SERIES], BLOCK, draws, ratio_to="lr").filter(F.col("n") >= BLOCK).select(SERIES, "low", "high")
    label = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("open")
    return got.join(boot, SERIES, "left").withColumn("label", F.when(F.col("low").isNotNull(), label))


def rolling_skill(oos: DataFrame, length: int, step: int = 21) -> DataFrame:
    """Skill of each window of ``length`` rows that begins at every ``step``-th row of a series."""
    frame = series().rowsBetween(0, length - 1)
    d = oos.withColumns({"k": F.row_number().over(series()) - 1, "n": F.count("*").over(frame), "a": F.avg(scoring.loss("p")).over(frame), "b": F.avg(scoring.loss("clim")).over(frame)})
    return d.filter((F.col("n") == length) & (F.col("k") % step == 0) & (F.col("b") > 0)).select(SERIES, F.col("k").cast("long").alias("k"), (1 - F.col("a") / F.col("b")).alias("skill"))


def skill_windows(oos: DataFrame, lengths: list[int], step: int = 21) -> DataFrame:
    """Quantiles of the rolling skill by length."""
    each = [rolling_skill(oos, n, step).withColumn("length", F.lit(n)) for n in lengths]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    q = lambda p: F.percentile("skill", p)
    return rows.groupBy(SERIES, "length").agg(F.count("*").alias("windows"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.min("skill").alias("low"), F.max("skill").alias("high"), F.avg((F.col("skill") < 0).cast("double")).alias("share_negative"))


def percentile_in(values: DataFrame, windows: DataFrame) -> DataFrame:
    """values (skill) by the share of windows' skills that aren't above: null without windows."""
    met = values.select(SERIES, F.col("skill").alias("live")).join(windows.select(SERIES, "skill"), SERIES, "left")
    return met.groupBy(SERIES).agg(F.first("live").alias("skill"), F.avg((F.col("skill") <= F.col("live")).cast("double")).alias("percentile"))


def latest_panel(live: DataFrame, windows: DataFrame, months: DataFrame, draws: int = 4_000) -> DataFrame:
    """One row a series: live scores, percentile among past windows, and what the record's age hides."""
    s = score(live, "p", ["clim"], draws=draws).withColumnRenamed("skill_clim", "skill")
    d = s.join(percentile_in(s, windows).select(SERIES, "percentile"), SERIES, "left").join(months.select(SERIES, "months"), SERIES, "left")
    d = d.withColumn("stage", stage(F.col("n_eff"), F.col("months")))
    return redacted(d, "stage", {"skill": "bss", "low": "bss", "high": "bss", "percentile": "hist_pct", "label": "verdict"})


def more_alarms(live: DataFrame) -> DataFrame:
    """series_id, pos, code, value of the alarms beside those of ``store.alarms``: only full windows are judged.

    live: ln_err, sigma, rv, w, ret, dd, state, dp (change of a recomputed p), hit (of a range), y, p, x (an input), x_low and x_high.
    """
    mean = lambda x, k: full(x, F.avg(x), trailing(k), k)
    away = F.when(F.col("x").isNotNull(), (~F.col("x").between(F.col("x_low"), F.col("x_high"))).cast("int"))
    days = full(away, F.sum(away), trailing(OUT_OF_RANGE_DAYS), OUT_OF_RANGE_DAYS)
    occupied = (F.col("state") != "normal").cast("double")
    checks = {
        "D3_bias": (mean(F.col("ln_err"), 60), lambda v: F.abs(v) > 0.35),
        "D4": (mean(F.col("rv"), 60) / F.nullif(mean(F.col("sigma"), 60), F.lit(0.0)), lambda v: v > 1.5),
        "D4b": (F.col("dd"), lambda v: v < -3.5 * 0.10),
        "D5_states": (mean(occupied, 252), lambda v: v > 0.75),
        "D7": (full(F.col("dp"), F.max(F.abs("dp")), trailing(20), 20), lambda v: v > 0.01),
        "D8": (mean(F.col("hit"), 240), lambda v: v < 0.5),
        "D10": (F.abs("dp"), lambda v: v > 1e-6),
        "D11": (days, lambda v: v >= OUT_OF_RANGE_DAYS),
    }
    found = live.withColumns({code: F.round(v.cast("double"), 6) for code, (v, _) in checks.items()})
    rung = F.array(*(F.when(test(F.col(code)), F.struct(F.lit(code).alias("code"), F.col(code).alias("value"))) for code, (_, test) in checks.items()))
    return found.select(SERIES, "pos", F.explode(F.filter(rung, lambda a: a.isNotNull())).alias("a")).select(SERIES, "pos", "a.code", "a.value")


def auc_alarm(live: DataFrame, k: int = 756) -> DataFrame:
    """D9 by series: the AUC of the last k rows, if there are as many, where it is below a half."""
    last = live.filter("p is not null and y is not null").withColumn("_n", F.row_number().over(Window.partitionBy(SERIES).orderBy(F.col("pos").desc()))).filter(F.col("_n") <= k)
    return scoring.auc(last, "p", [SERIES]).filter((F.col("n") == k) & (F.col("auc") < 0.5)).select(SERIES, F.lit("D9").alias("code"), F.round("auc", 6).alias("value"))


def weight_outcomes(rows: DataFrame, horizon: int = 20, cost_bps: float = 5.0) -> DataFrame:
    """What came of each row's weight in the next sessions: worst fall, realised volatility, rule and hold returns, the rule's worst fall.

    rows: pos, close, w (held where it is null). Null until the horizon is known.
    """
    w = F.last("w", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    d = rows.withColumn("w_held", w)
    before = F.lag("w_held").over(series())
    ret = F.col("close") / F.lag("close").over(series()) - 1
    cost = cost_bps / 10_000 * F.abs(F.coalesce(before - F.lag("w_held", 2).over(series()), F.lit(0.0)))
    d = d.withColumns({"ret": ret, "rule_ret": (1 + before * ret) * (1 - cost) - 1})
    known = F.lead("close", horizon).over(series()).isNotNull()
    grow = lambda c: F.exp(F.sum(F.log1p(c)).over(ahead(horizon))) - 1
    paths = F.transform(F.collect_list("rule_ret").over(ahead(horizon)), lambda x: x)
    # wealth along the next sessions, its peak and the worst fall from it: a fold over ``horizon`` numbers of the row
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd"))
    def step(s: Column, r: Column) -> Column:
        wealth = s["w"] * (1 + r)
        top = F.greatest(s["top"], wealth)
        return F.struct(wealth.alias("w"), top.alias("top"), F.least(s["dd"], wealth / top - 1).alias("dd"))

    worst = F.aggregate(paths, start, step)["dd"]
    only = lambda x: F.round(F.when(known, x), 6)
    vol = F.stddev_samp(F.log1p("ret")).over(ahead(horizon)) * F.sqrt(F.lit(float(YEAR)))
    return d.select(SERIES, "pos", only(F.min("close").over(ahead(horizon)) / F.col("close") - 1).alias("fwd_maxdd"), only(vol).alias("rv_next"), only(grow("rule_ret")).alias("rule_next"), only(grow("ret")).alias("hold_next"), only(worst).alias("rule_dd_next"))


def checked(rows: DataFrame) -> DataFrame:
    """Ledger rows with the faults of each as a list: nothing is stored that has any.

    rows: asof, variant, tone, p, p_lo, p_hi, mode, state, w_exec.
    """
    c = F.col
    inside = lambda n, low=0.0, high=1.0: c(n).isNull() | c(n).between(low, high)
    one_of = lambda n, values: c(n).isNull() | c(n).isin(*values)
    rules = {
        "asof": c("asof").isNotNull(), "variant": c("variant").isin("faithful", "completed"), "tone": one_of("tone", TONES), "p": inside("p"), "band": F.coalesce((c("p_lo") <= c("p")) & (c("p") <= c("p_hi")), F.lit(True)),
        "mode": one_of("mode", MODES), "state": one_of("state", STATES), "w_exec": inside("w_exec"), "info_only": F.coalesce(~((c("mode") == "info_only") & c("w_exec").isNotNull()), F.lit(True)),
    }
    return rows.withColumn("faults", F.array_join(F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull()), ","))


def members_json(members: dict[str, Column]) -> Column:
    """Members' values as JSON in the order given; missing ones are null, not left out."""
    return F.to_json(F.struct(*(F.round(v, 6).alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def alarm_list(codes: Column) -> Column:
    """Codes of an array once each, in order, joined by commas; null if there are none."""
    text = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(codes, lambda x: F.trim(x)), lambda x: x != ""))), ",")
    return F.when(text != "", text)


def truth(v: Column) -> Column:
    """A flag written in one of the usual ways; null if it is none of them."""
    t = F.lower(F.trim(v.cast("string")))
    return F.when(t.isin("1", "1.0", "true", "t", "yes", "y"), True).when(t.isin("0", "0.0", "false", "f", "no", "n", ""), False)


def warning_key(message: Column) -> Column:
    """A warning without its dates, so that equal warnings of different days are one."""
    return F.regexp_replace(message, r"\d{4}-\d{2}-\d{2}", "<date>")


def probability_source(mode: Column, model: Column) -> Column:
    """Where a row's probability comes from: the deployed model, or one shown for information."""
    return F.when(mode.isNull() | model.isNull(), "none").when(mode == "tones", F.concat(F.lit("model:"), model)).otherwise(F.concat(F.lit("info:"), model))


def promoted(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """An older ledger in today's columns: missing ones null, unknown ones kept to the right."""
    known = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    return df.select(*known, *(c for c in df.columns if c not in schema))


def appended_alarms(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The alarm log with the rows whose day and code it lacks; of equal ones the first by all their columns."""
    w = Window.partitionBy("asof", "code").orderBy(*(F.col(c).asc_nulls_last() for c in rows.columns))
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return log.unionByName(once.join(log.select("asof", "code"), ["asof", "code"], "left_anti"))
