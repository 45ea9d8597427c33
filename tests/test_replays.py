"""Replays: windows of bars by plain recomputation, and rows that don't change when later sessions come."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions.expr import SERIES
from tidemark.operators import bootstrap, ensemble, evaluation, folds, kill_replay, portfolio, timeframes
from tidemark.plans import replays


def plain_histogram(closes):
    f = s = closes[0]
    g, out = 0.0, [0.0]
    for x in closes[1:]:
        f, s = f + 2 / 13 * (x - f), s + 2 / 27 * (x - s)
        g += 2 / 10 * (f - s - g)
        out.append(f - s - g)
    return out


def test_averages_of_a_window_follow_from_the_running_ones():
    draw = random.Random(1)
    closes = [100.0]
    for _ in range(400):
        closes.append(closes[-1] * (1 + draw.gauss(0, 0.01)))
    states, v = [], None
    for x in closes:
        v = timeframes.Averages.step(v, x)
        states.append(v)
    for first in (0, 1, 7, 200, 399, 400):
        want = plain_histogram(closes[first:])
        got = [timeframes.Averages.histogram(states[i], states[first], i - first) for i in range(first, len(closes))]
        assert got == pytest.approx(want, abs=1e-10)


def test_later_sessions_change_nothing(spark):
    """The replay of a series that ends early is the beginning of the whole one."""
    days = replays._days(spark, SF).filter(f"{SERIES} = 'S0'").cache()
    parts = [f"part{i}" for i in range(replays.PARTS)]
    whole = {tuple(r) for r in timeframes.replay(timeframes.metrics(days, parts)).collect()}
    ends = sorted(r[1] for r in whole)
    for end in (ends[len(ends) // 3], ends[2 * len(ends) // 3]):
        cut = {tuple(r) for r in timeframes.replay(timeframes.metrics(days.filter(f"pos <= {end}"), parts)).collect()}
        assert cut == {r for r in whole if r[1] <= end} and cut


def test_equal_baskets_compound_mean_returns(spark):
    days = replays._days(spark, SF).filter(f"{SERIES} = 'S0'").cache()
    parts = [f"part{i}" for i in range(replays.PARTS)]
    rows = {r["pos"]: [r[p] for p in parts] for r in days.select("pos", *parts).collect()}
    closes = {r["pos"]: r["close"] for r in days.select("pos", "close").collect()}
    i = timeframes.VIEWS.index(("daily", "faithful", 0))
    for r in timeframes.views(days, parts, equal=True).select("pos", f"v{i}_rs").collect():
        if r[0] > 400 and r[0] % 50 == 0:
            level = 1.0
            for p in range(r[0] - 4, r[0] + 1):
                level *= 1 + sum(a / b - 1 for a, b in zip(rows[p], rows[p - 1], strict=True)) / len(parts)
            assert r[1] == pytest.approx((level - closes[r[0]] / closes[r[0] - 5]) * 100, abs=1e-8)


def drawn(n, draw, block, seed=0):
    """Rows of a resample, by hand."""
    blocks = -(-n // block)
    starts = [int(int(hashlib.md5(f"{seed}:{draw}:{i}".encode()).hexdigest()[:13], 16) / 2**52 * n) for i in range(blocks)]
    return np.concatenate([(s + np.arange(block)) % n for s in starts])[:n]


@pytest.mark.parametrize(("n", "block"), [(130, 40), (80, 40), (7, 40), (41, 40), (25, 3)])
def test_spread_bootstrap_by_a_plain_loop(spark, n, block):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("A/B", i, float(v), float(v * v + 1)) for i, v in enumerate(x)], "series_id string, pos int, v double, w double")
    df = df.unionByName(df.withColumn("series_id", F.lit("C")).withColumn("v", F.col("v") * 2))
    for ratio in (None, "w"):
        got = {r[SERIES]: r for r in bootstrap.interval(df, "v", [SERIES], block, 200, ratio_to=ratio).collect()}
        for name, scale in (("A/B", 1), ("C", 2)):
            v = x * scale
            stats = [1 - v[at].mean() / (x[at] ** 2 + 1).mean() if ratio else v[at].mean() for at in (drawn(n, k, block) for k in range(200))]
            low, high = np.percentile(stats, [2.5, 97.5])
            assert got[name]["low"] == pytest.approx(low, abs=1e-9) and got[name]["high"] == pytest.approx(high, abs=1e-9) and got[name]["n"] == n


def test_an_admitted_member_changes_the_next_test(spark):
    """Beside p2 alone m1 improves every block; beside p2 and the admitted h it spoils them."""
    rng = np.random.default_rng(3)
    rows = [(s, i, i // 40, int(rng.random() < 0.3)) for s in ("A", "B") for i in range(40 * 12)]
    d = spark.createDataFrame(rows, "series_id string, pos int, block int, y int")
    # in B h is useless, so m1 is still judged beside p2 alone
    d = d.withColumns({"m_p2": F.lit(0.8), "m_h": F.when(F.col(SERIES) == "A", -0.2).otherwise(0.9), "m_m1": F.lit(0.62)})
    got = {(r[SERIES], r["candidate"]): r for r in ensemble.admission_sequence(d, {"p2": "seed", "h": "shadow", "m1": "shadow"}, True, draws=400).collect()}
    assert got["A", "h"]["verdict"] == "ADMIT" and got["A", "m1"]["verdict"] == "SHADOW" and got["A", "m1"]["beside"] == "p2,h"
    assert got["B", "h"]["verdict"] == "SHADOW" and got["B", "m1"]["verdict"] == "ADMIT" and got["B", "m1"]["beside"] == "p2"


def test_shuffled_blocks_are_a_permutation(spark):
    oos = spark.createDataFrame([("A", i, float(i), i % 2) for i in range(130)], "series_id string, k long, p double, y int").withColumns({"lr": F.lit(1.0)})
    for r in kill_replay.shuffled(oos, 3).groupBy("shuffle").agg(F.sort_array(F.collect_list("k")).alias("k"), F.sum("lp").alias("s")).collect():
        assert r["k"] == list(range(130))
    noisy = kill_replay.noise(kill_replay.numbered(spark.createDataFrame([("A", f"2001-01-{1 + i % 28:02d}", 0.5 + 0.01 * (i % 5), i % 2, 0.5) for i in range(28)], "series_id string, d string, p double, y int, clim double").withColumn("date", F.to_date("d")), "p", "y", "clim"))
    assert noisy.count() == 28 and noisy.filter("lp between 0 and 1").count() == 28


def test_sizing_moves_on_the_grid(spark):
    """0.45 is a whole band above 0.35, which the grid holds to ten places."""
    rows = [("A", 1, 0.35, 1.0, False), ("A", 2, 0.45, 1.0, True), ("A", 3, 0.54, 1.0, True), ("A", 4, 0.55, 1.0, True)]
    df = spark.createDataFrame(rows, "series_id string, pos int, w_target double, mult double, week_end boolean")
    got = [(r["w_exec"], r["reason"]) for r in folds.sizing(df).orderBy("pos").collect()]
    assert got == [(0.35, "init"), (0.45, "weekly"), (0.45, "hold"), (0.55, "weekly")]


def test_names_with_slashes_stay_apart(spark):
    """Series BRK/B and LEN/B come back as they are from every operator that keys paths by several columns."""
    rows = [(s, i, 0.1 + 0.01 * (i % 7), 0.12, "normal" if i % 5 else "reduce", i % 5 == 0, i % 20 == 0) for s in ("BRK/B", "LEN/B") for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, pos int, sigma double, sigma_har double, state string, week_end boolean, month_end boolean")
    got = portfolio.variants(df, 0.1)
    assert {r[0]: r[1] for r in got.groupBy(SERIES).count().collect()} == dict.fromkeys(("BRK/B", "LEN/B"), 60 * (len(portfolio.VARIANTS) + 2))
    closes = df.select(SERIES, "pos", F.date_add(F.lit("2001-01-01").cast("date"), F.col("pos")).alias("date"), (100 + F.col("pos")).cast("double").alias("close"))
    spans = spark.createDataFrame([("all/of it", "2001-01-01", "2001-12-31")], "name string, a string, b string").select("name", F.to_date("a").alias("first"), F.to_date("b").alias("last"))
    done = portfolio.backtest(got.withColumn("w", F.col("w_exec")), closes, spans, {})
    assert {r[0] for r in done.select(SERIES).collect()} == {"BRK/B", "LEN/B"} and {r[0] for r in done.select("window").collect()} == {"all/of it"}
    warn = df.select(SERIES, "pos", (F.col("pos") % 9 == 0).alias("warn"), (F.col("pos") % 2).alias("y"))
    falls = spark.createDataFrame([("BRK/B", 20, 30), ("LEN/B", 25, 40)], "series_id string, peak_pos int, trough_pos int")
    assert {r[SERIES]: r["shifts"] for r in evaluation.shifted_alarms(warn, falls, [1, 5, 9]).collect()} == {"BRK/B": 3, "LEN/B": 3}


def test_smoothed_by_a_plain_forward_and_backward_pass(spark):
    """Both passes over arrays (scaled alphas and betas) give the folds' probabilities; both states sum to one."""
    from tidemark.operators import fit, regime
    from tidemark.plans import research

    d, params = research._fixed(spark, SF)
    d = d.filter("pos % 37 <> 5")
    got = regime.smoothed(d, params).toPandas()
    t = research.THETA
    a = np.array([[t["p00"], 1 - t["p00"]], [1 - t["p11"], t["p11"]]])
    mean = np.array([[t["mean_r0"], t["mean_v0"]], [t["mean_r1"], t["mean_v1"]]])
    cov = np.array([[[t[f"var_r{k}"], t[f"cov_rv{k}"]], [t[f"cov_rv{k}"], t[f"var_v{k}"]]] for k in range(2)])
    for name, g in d.select(SERIES, "pos", "r100", "ln_rv10").toPandas().groupby(SERIES):
        g = g.sort_values("pos")
        x = g[["r100", "ln_rv10"]].to_numpy(float)
        good = np.isfinite(x).all(1)
        both = fit.posteriors(x[good], a, mean, cov)[0]
        assert both.sum(1) == pytest.approx(1)
        mine = got[got[SERIES] == name].sort_values("pos")["p_smooth"].to_numpy(float)
        assert np.isnan(mine[~good]).all() and mine[good] == pytest.approx(both[:, 1], abs=1e-9)


def test_extended_rungs_by_numpy(spark, monkeypatch):
    """Means of forecasts row by row; the added rung's coefficients solve the penalised likelihood of its training rows."""
    from tidemark.operators import fit, ladder

    rng = np.random.default_rng(9)
    n = 1300
    x, h = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x + 0.8 * h - 1)))).astype(int)
    rows = [("A/B", i, 2000 + i // 260, float(x[i]), int(y[i]), 0.3, 0.2, 0.4) for i in range(n)]
    walked = spark.createDataFrame(rows, "series_id string, pos int, year int, x1 double, y int, p_M1 double, p_M3 double, p_B1 double").withColumns({"date": F.make_date("year", F.lit(1), F.lit(2)), "block": F.col("year"), "clim": F.lit(0.25)}).drop("year")
    member = spark.createDataFrame([("A/B", i, float(1 / (1 + np.exp(-h[i]))), float(h[i])) for i in range(n)], "series_id string, pos int, m_h double, x_hmm double")
    got = {r["pos"]: r for r in ladder.extended(walked, member, ["x1"]).collect()}
    assert got[1200]["p_M3H"] == pytest.approx((0.2 + got[1200]["p_H"]) / 2) and got[1200]["p_ens3"] == pytest.approx((0.2 + 0.3 + got[1200]["p_H"]) / 3)
    refit = 260 * (1200 // 260)
    known = refit - fit.PURGE - 1
    coef = fit.irls(np.column_stack([x, h])[: known + 1], y[: known + 1].astype(float))
    z = coef[0] + coef[1] * x[1200] + coef[2] * h[1200]
    assert got[1200]["p_M4a"] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)
    steps = ladder.ladder_table(spark.createDataFrame(list(got.values()), ladder.extended(walked, member, ["x1"]).schema), [("M3", "M4a")], ladder.EXTENDED, draws=50)
    assert steps.filter("block is null").first()["gain"] > 0
