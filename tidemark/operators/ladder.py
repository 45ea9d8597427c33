"""A ladder of models scored step by step and block by block, and the rules that accept a rung."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, ratio
from tidemark.operators import bootstrap, fit, scoring

LEAST_BLOCK, WIN_SHARE = -0.05, 8 / 11
RUNGS = ("M1", "M2", "M3")
BEFORE = {"M1": "M0", "M2": "M1", "M3": "M2"}


def first_refit_ok(df: DataFrame, deep: DataFrame, least_rows: int = 2_000, purge: int = fit.PURGE) -> DataFrame:
    """Refits with the labelled rows they may learn from and the deep episodes whose trough lies among them: whether both suffice.

    df: pos, date, y; deep: peak_pos, trough_pos.
    """
    train = fit.training(df, purge).filter("y is not null").groupBy(SERIES, "year").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))
    every = fit.refits(df).select(SERIES, "year", "refit_pos").join(train, [SERIES, "year"], "left")
    seen = every.join(deep.select(SERIES, "trough_pos"), SERIES).filter(F.col("trough_pos") <= F.col("last_pos")).groupBy(SERIES, "year").agg(F.count("*").alias("episodes"))
    got = every.join(seen, [SERIES, "year"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "episodes": F.coalesce("episodes", F.lit(0))})
    return got.select(SERIES, "year", "refit_pos", "n", "episodes", ((F.col("n") >= least_rows) & (F.col("episodes") >= 1)).alias("ok"))


def walk_forward(df: DataFrame, ladder: dict[str, list[str]]) -> DataFrame:
    """df with p_<rung> of each rung of the ladder: its own features, refit at each year on what was known, and ``clim``."""
    out = df
    for rung, names in ladder.items():
        scored = fit.score_segments(df, fit.logit_walk_forward(df, names), names).select(SERIES, "pos", F.col("pred").alias(f"p_{rung}"))
        out = out.join(scored, [SERIES, "pos"])
    return out.withColumn("clim", scoring.climatology())


def unpivoted(oos: DataFrame, rungs: list[str]) -> DataFrame:
    """A row for each rung of each row whose forecasts, label and reference are all there."""
    whole = oos.dropna(subset=["y", "clim", *(f"p_{r}" for r in rungs)])
    cells = F.array(*(F.struct(F.lit(r).alias("rung"), F.col(f"p_{r}").alias("p")) for r in rungs))
    return whole.select(SERIES, "pos", "block", "y", "clim", F.explode(cells).alias("x")).select(SERIES, "pos", "block", "y", "clim", "x.rung", "x.p")


def rung_table(oos: DataFrame, rungs: list[str]) -> DataFrame:
    """Brier score, skill and calibration in the large of each rung, by series and block and over all blocks (block null)."""
    rows = unpivoted(oos, rungs)
    sets = [[F.col(SERIES), F.col("rung"), F.col("block")], [F.col(SERIES), F.col("rung")]]
    got = rows.groupingSets(sets, SERIES, "rung", "block").agg(F.count("*").alias("n"), F.avg(scoring.loss("p")).alias("brier"), F.avg(scoring.loss("clim")).alias("brier_clim"), (F.avg("p") - F.avg("y")).alias("bias"))
    return got.withColumn("skill", 1 - ratio(F.col("brier"), F.col("brier_clim")))


def steps(oos: DataFrame, pairs: list[tuple[str, str]], columns: dict[str, str]) -> DataFrame:
    """A row for each step (from, to) of each row with both forecasts: losses before and after, ``step`` and ``block``."""
    cells = F.array(*(F.struct(F.lit(f"{a}->{b}").alias("step"), F.pow(F.col(columns[a]) - F.col("y"), 2).alias("la"), F.pow(F.col(columns[b]) - F.col("y"), 2).alias("lb")) for a, b in pairs))
    return oos.select(SERIES, "pos", "block", "y", F.explode(cells).alias("x")).select(SERIES, "pos", "block", "x.step", "x.la", "x.lb").dropna(subset=["la", "lb"])


def ladder_table(oos: DataFrame, pairs: list[tuple[str, str]], columns: dict[str, str], lags: int = scoring.HAC, draws: int = 4_000) -> DataFrame:
    """Each step by block and over all (block null): scores, mean gain with its block bootstrap, Diebold-Mariano t and p, phases.

    A gain is positive where the step is to the better. Autocovariances come from lags over the rows of a step.
    """
    once = steps(oos, pairs, columns).withColumn("gain", F.col("la") - F.col("lb"))
    both = once.unionByName(once.withColumn("block", F.lit(None).cast(dict(oos.dtypes)["block"])))
    keys = [SERIES, "step", "block"]
    w = Window.partitionBy(*keys).orderBy("pos")
    d = both.withColumn("mean", F.avg("gain").over(Window.partitionBy(*keys))).withColumn("e", F.col("gain") - F.col("mean"))
    terms = [F.col("e") * F.col("e")] + [2 * (1 - j / (lags + 1)) * F.col("e") * F.coalesce(F.lag("e", j).over(w), F.lit(0.0)) for j in range(1, lags + 1)]
    sums = d.withColumn("s", reduce(lambda a, b: a + b, terms)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("la").alias("brier_from"), F.avg("lb").alias("brier_to"), F.first("mean").alias("gain"), F.sum("s").alias("s"))
    t = ratio(F.col("gain"), F.sqrt(F.when(F.col("s") > 0, F.col("s"))) / F.col("n"))
    sums = sums.select(*keys, "n", "brier_from", "brier_to", "gain", (1 - ratio(F.col("brier_to"), F.col("brier_from"))).alias("skill"), t.alias("dm_t"), two_sided(t).alias("dm_p"))
    by_phase = both.groupBy(*keys, ((F.col("pos") - 1) % scoring.OFFSETS).alias("phase")).agg((1 - ratio(F.avg("lb"), F.avg("la"))).alias("x"))
    phases = by_phase.groupBy(*keys).agg(F.min("x").alias("phase_low"), F.percentile("x", 0.5).alias("phase_median"), F.max("x").alias("phase_high"), F.avg((F.col("x") > 0).cast("double")).alias("phase_positive"))
    named = both.withColumn("_block", F.coalesce(F.col("block").cast("string"), F.lit("all")))
    boot = bootstrap.interval(named, "gain", [SERIES, "step", "_block"], draws=draws).select(SERIES, "step", "_block", "low", "high")
    key = F.coalesce(F.col("block").cast("string"), F.lit("all"))
    out = sums.withColumn("_block", key).join(phases.withColumn("_block", key).drop("block"), [SERIES, "step", "_block"])
    return out.join(boot, [SERIES, "step", "_block"]).drop("_block")


def two_sided(t: Column) -> Column:
    """Two-sided p of a normal statistic."""
    from tidemark.functions.expr import phi

    return 2 * (1 - phi(F.abs(t)))


def check_blocks(blocks: DataFrame, start: str, end: str, least: int = 18, most: int = 24) -> DataFrame:
    """Blocks (first, last; last is outside) that don't follow the one before, are empty, or have another length in months."""
    w = Window.orderBy("first")  # a dozen blocks
    months = (F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first")
    d = blocks.withColumns({"before": F.coalesce(F.lag("last").over(w), F.lit(start).cast("date")), "next": F.lead("first").over(w), "months": months})
    fault = (
        F.when(F.col("first") != F.col("before"), "gap").when(F.col("last") <= F.col("first"), "empty").when(~F.col("months").between(least, most), "length")
        .when(F.col("next").isNull() & (F.col("last") != F.lit(end).cast("date")), "end")
    )
    return d.select("first", "last", "months", fault.alias("fault"))


def literal_rule(blocks: DataFrame) -> DataFrame:
    """By table and rung: every block beats the climatology and is no worse than the implied probability. blocks: n, skill_clim, skill_vix."""
    ok = lambda c: F.bool_and((F.col("n") > 0) & F.coalesce(c, F.lit(False)))
    got = blocks.groupBy(SERIES, "table", "rung").agg(F.count("*").alias("blocks"), ok(F.col("skill_clim") > 0).alias("pass_clim"), ok(F.col("skill_vix") >= 0).alias("pass_vix"), F.min("skill_clim").alias("least_clim"), F.min("skill_vix").alias("least_vix"))
    return got.withColumn("passed", F.col("pass_clim") & F.col("pass_vix"))


def amended_rule(blocks: DataFrame, pooled: DataFrame, low: DataFrame) -> DataFrame:
    """By table and rung: A beats the climatology, B the implied probability, C the rung below, each pooled and in most blocks.

    pooled: skill_clim and skill_vix over all rows; low: the lower bounds low_clim, low_vix and low_info of the gains.
    """
    counts = blocks.groupBy(SERIES, "table", "rung").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("skill_clim") > 0).alias("n_clim"), F.count_if(F.col("skill_vix") >= 0).alias("n_vix"), F.min("skill_clim").alias("least_clim")
    )
    d = counts.join(pooled, [SERIES, "table", "rung"]).join(low, [SERIES, "table", "rung"]).withColumn("need", F.ceil(F.col("blocks") * WIN_SHARE - 1e-9))
    sure = lambda c: F.coalesce(c, F.lit(False))
    full = F.col("empty") == 0
    d = d.withColumns({
        "a": sure((F.col("skill_clim") > 0) & (F.col("low_clim") > 0) & full & (F.col("least_clim") >= LEAST_BLOCK) & (F.col("n_clim") >= F.col("need"))),
        "b": sure((F.col("skill_vix") >= 0) & (F.col("low_vix") >= 0) & full & (F.col("n_vix") >= F.col("need"))), "c": sure(F.col("low_info") > 0),
    })
    return d.withColumn("passed", F.col("a") & F.col("b") & F.col("c"))


def accepted(verdicts: DataFrame, tables: list[str]) -> DataFrame:
    """The highest rung that passes in every one of the tables, by series; ``info_only`` without one."""
    asked = verdicts.filter(F.col("table").isin(*tables))
    rank = F.array_position(F.array(*map(F.lit, RUNGS)), F.col("rung"))
    common = asked.groupBy(SERIES, "rung").agg((F.count_if("passed") == len(tables)).alias("passed"))
    best = common.groupBy(SERIES).agg(F.max_by(F.when(F.col("passed"), F.col("rung")), F.when(F.col("passed"), rank).otherwise(0)).alias("tone_model"))
    failed = asked.filter(~F.col("passed")).groupBy(SERIES).agg(F.array_join(F.sort_array(F.collect_set("table")), ",").alias("failing_tables"))
    return best.join(failed, SERIES, "left").withColumn("mode", F.when(F.col("tone_model").isNotNull(), "tones").otherwise("info_only"))


def rows_digest(df: DataFrame, by: list[str], columns: list[str], places: int = 9) -> DataFrame:
    """A digest of the rows of each group, whatever their order: equal for equal runs. Values count to ``places`` places."""
    cell = lambda c, kind: F.format_number(F.round(c, places), places) if kind == "double" else F.col(c).cast("string")
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws("|", *(F.coalesce(cell(c, kinds[c]), F.lit("~")) for c in columns)), 256)
    parts = df.select(*by, F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("h"), F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(38,0)").alias("g"))
    return parts.groupBy(*by).agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"), F.sum("g").cast("string").alias("second"))


#: The steps beyond the ladder's own, from and to.
EXTENSION = (("M1", "H"), ("M3", "H"), ("M3", "M3+H"), ("M3", "M3+M1"), ("M3", "M3+M1+H"), ("M3", "M4a"), ("B1", "H"))


def extended(walked: DataFrame, member: DataFrame, features: list[str]) -> DataFrame:
    """walked (p_M1, p_M3, p_B1, features, y, clim, block) with p_H of the regime member, the means of rungs and member, and
    p_M4a, the ladder's last rung with the member's logit as one more feature, refit on the same days. Scored only."""
    d = walked.join(member.select(SERIES, "pos", F.col("m_h").alias("p_H"), "x_hmm"), [SERIES, "pos"], "left")
    fitted = fit.score_segments(d, fit.logit_walk_forward(d, [*features, "x_hmm"]), [*features, "x_hmm"]).select(SERIES, "pos", F.col("pred").alias("p_M4a"))
    mean = lambda *names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return d.join(fitted, [SERIES, "pos"], "left").withColumns({"p_M3H": mean("p_M3", "p_H"), "p_M3M1": mean("p_M3", "p_M1"), "p_ens3": mean("p_M3", "p_M1", "p_H")})


EXTENDED = {"M1": "p_M1", "M3": "p_M3", "B1": "p_B1", "H": "p_H", "M3+H": "p_M3H", "M3+M1": "p_M3M1", "M3+M1+H": "p_ens3", "M4a": "p_M4a"}


def ablations(members: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """By series and ablated member: rows, Brier score, skill and AUC, on the rows that all members have. members: m_h by name."""
    rows = labels.select(SERIES, "pos", "y", "clim").dropna()
    for name, m in members.items():
        rows = rows.join(m.select(SERIES, "pos", F.col("m_h").alias(f"_{name}")).dropna(), [SERIES, "pos"])
    cells = F.array(*(F.struct(F.lit(n).alias("member"), F.col(f"_{n}").alias("p")) for n in members))
    long = rows.select(SERIES, "pos", "y", "clim", F.explode(cells).alias("x")).select(SERIES, "pos", "y", "clim", "x.member", "x.p")
    scores = long.groupBy(SERIES, "member").agg(F.avg(scoring.loss("p")).alias("brier"), F.avg(scoring.loss("clim")).alias("brier_clim"))
    got = scores.join(scoring.auc(long, "p", [SERIES, "member"]), [SERIES, "member"])
    return got.select(SERIES, "member", "n", "brier", (1 - ratio(F.col("brier"), F.col("brier_clim"))).alias("skill"), "auc")
