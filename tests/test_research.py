"""What SQL can't express, against plain loops and numpy: episodes, pools, sizing, regimes, shifts, fits, stored frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_operators import closes, walk
from tidemark.functions.expr import SERIES
from tidemark.operators import bootstrap, ensemble, evaluation, events, fit, folds, ladder, portfolio, regime, scenarios, scoring, sessions, tracking, vol
from tidemark.plans import catalog, research
from tidemark.sources import feeds, market


def series_of(df, *columns):
    got = df.select(SERIES, "pos", *columns).toPandas().sort_values([SERIES, "pos"])
    return {k: g.reset_index(drop=True) for k, g in got.groupby(SERIES)}


def plain_episodes(c, thr):
    """Parts of falls as a state machine over one list of closes."""
    out, open_parts, top, i = [], [], 0, 1
    while i < len(c):
        if c[i] > c[top]:
            top = i
        elif c[i] / c[top] - 1 <= -thr:
            peak, low, high = top, i, i
            j = i + 1
            while j < len(c) and c[j] <= c[top]:
                if c[high] >= c[low] * (1 + thr) and c[j] / c[high] - 1 <= -thr:
                    open_parts.append((peak, low))
                    peak, low, high = high, j, j
                elif c[j] < c[low]:
                    low = high = j
                elif c[j] > c[high]:
                    high = j
                j += 1
            open_parts.append((peak, low))
            out += [(p, q, j if j < len(c) else None) for p, q in open_parts]
            open_parts = []
            top, i = j, j
        i += 1
    return out


def test_split_episodes_by_a_plain_loop(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for seed in range(4):
            c = [round(x, 1 if seed % 2 else 6) for x in walk(700, seed)]  # coarse prices tie
            got = evaluation.split_episodes(closes(spark, c), 0.04).orderBy("peak_pos", "trough_pos").collect()
            assert [(r["peak_pos"] - 1, r["trough_pos"] - 1, None if r["recovery_pos"] is None else r["recovery_pos"] - 1) for r in got] == sorted(plain_episodes(c, 0.04))
            assert all(r["depth"] == c[r["trough_pos"] - 1] / c[r["peak_pos"] - 1] - 1 for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_shifts_equal_rolled_warnings(spark):
    rng = np.random.default_rng(2)
    warn, y = rng.random(300) < 0.2, rng.integers(0, 2, 300)
    rows = spark.createDataFrame([("A", i + 1, bool(w), int(v)) for i, (w, v) in enumerate(zip(warn, y, strict=True))], "series_id string, pos int, warn boolean, y int")
    eps = [(40, 60), (120, 121), (250, 299)]
    e = spark.createDataFrame([("A", p, t) for p, t in eps], "series_id string, peak_pos int, trough_pos int")
    offsets = [1, 17, 150, 299]
    rates, leads, shares = [], [], []
    for k in offsets:
        w = np.roll(warn, k)
        hits = [np.flatnonzero(w[max(p - 20, 1) - 1 : t]) for p, t in eps]
        rates.append(np.mean([len(h) > 0 for h in hits]))
        found = [p - (max(p - 20, 1) + h[0]) for (p, _), h in zip(eps, hits, strict=True) if len(h)]
        leads.append(np.median(found))
        starts = np.flatnonzero(w & ~np.concatenate(([False], w[:-1])))
        shares.append(y[starts].mean())
    got = evaluation.shifted_alarms(rows, e, offsets).first()
    assert got["shifts"] == 4 and got["detection_mean"] == pytest.approx(np.mean(rates)) and got["lead_p50"] == pytest.approx(np.quantile(leads, 0.5)) and got["true_share_mean"] == pytest.approx(np.mean(shares))


def test_pools_by_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    cases = [[int(x) for x in rng.integers(0, 900, 9)] for _ in range(30)] + [[0] * 9, [5] * 9, [400] + [0] * 8, [0] * 8 + [399], [400] * 9]
    rows = spark.createDataFrame([(str(k), b, n) for k, case in enumerate(cases) for b, n in enumerate(case)], "series_id string, bin int, n long")
    got = {}
    for r in scenarios.pooled(rows, [SERIES]).collect():
        got.setdefault(int(r[SERIES]), {})[r["bin"]] = r["pool"]
    for k, case in enumerate(cases):
        pools, held, tail = [[]], 0, False
        for b, n in enumerate(case):
            pools[-1].append(b)
            held += n
            tail = held / 20 < 20
            if not tail:
                pools.append([])
                held = 0
        last = pools.pop()
        if last and pools:
            pools[-1] += last
        elif last:
            pools = [last]
        assert got[k] == {b: i for i, pool in enumerate(pools) for b in pool}, case


def test_sizing_rules_by_plain_loops(spark):
    rows = research._sizing_rows(spark, SF).select(SERIES, "pos", "sigma", "sigma_har", "state", "week_end", "month_end")
    got = series_of(portfolio.variants(rows), "variant", "w_exec")
    clip = lambda x: min(max(x, 0.25), 1.0)
    for name, g in rows.toPandas().sort_values([SERIES, "pos"]).groupby(SERIES):
        done = {v: x.set_index("pos")["w_exec"] for v, x in got[name].groupby("variant")}
        assert set(done) == set(portfolio.VARIANTS) | {"lag", "10bp"}
        for variant, (kind, mult, grid, band, check, at_once, own) in portfolio.VARIANTS.items():
            w = last_m = None
            before = {}
            for i, r in enumerate(g.itertuples(index=False)):
                m, mild = (None, None) if r.state is None else (portfolio.MULTIPLIER[r.state], portfolio.MILD[r.state])
                used = {"mult": m, "mild": mild, "one": 1.0}[mult]
                s = r.sigma_har if kind == "har" else r.sigma
                wv = clip((own or 0.10) / s) if s == s and s is not None and s > 0 else None
                part = {"floored": m, "product": m, "vol": 1.0, "mild": mild, "least": m, "har": m}[kind]
                goal = None
                if wv is not None and part is not None:
                    goal = min(wv, part) if kind == "least" else wv * part
                    goal = clip(goal) if kind in ("floored", "mild") else goal
                due = {"week_end": r.week_end, "month_end": r.month_end, "daily": True, "month_or_change": r.month_end or i == 0 or before.get("m") != m, "month_or_mild": r.month_end or i == 0 or before.get("mild") != mild}[check]
                if goal is not None and used is not None:
                    on = round(round(goal / grid) * grid, 10)
                    if w is None:
                        w = on
                    elif at_once and last_m is not None and used < last_m:
                        w = min(on, w)
                    elif due and abs(goal - w) >= band:
                        w = on
                last_m = used if used is not None else last_m
                before = {"m": m, "mild": mild}
                have = done[variant].loc[r.pos]
                assert (w is None and have != have) or have == pytest.approx(w, abs=1e-12), (variant, r.pos)
        assert done["10bp"].equals(done["nofloor"]) and done["lag"].iloc[1:].reset_index(drop=True).equals(done["nofloor"].iloc[:-1].reset_index(drop=True))


def test_most_changes_of_the_state_machine():
    assert portfolio.most_changes(folds.DecisionConfig()) == 3
    assert portfolio.most_changes(folds.DecisionConfig(dwell=0)) == 5


def test_regime_filter_by_a_plain_loop_and_its_prefix(spark):
    d, params = research._fixed(spark, SF)
    t = research.THETA
    mean = [[t["mean_r0"], t["mean_v0"]], [t["mean_r1"], t["mean_v1"]]]
    cov = [np.array([[t[f"var_r{k}"], t[f"cov_rv{k}"]], [t[f"cov_rv{k}"], t[f"var_v{k}"]]]) for k in range(2)]
    got = series_of(regime.filtered(d, params), "p_high")
    seen = series_of(d, "r100", "ln_rv10")
    for name, g in seen.items():
        p, want = None, []
        for x in g[["r100", "ln_rv10"]].to_numpy(float):
            high = 0.02 / 0.07 if p is None else p * t["p11"] + (1 - p) * (1 - t["p00"])
            if np.isfinite(x).all():
                like = [math.exp(-0.5 * (x - m) @ np.linalg.inv(c) @ (x - m)) / math.sqrt(np.linalg.det(c)) for m, c in zip(mean, cov, strict=True)]
                p = high * like[1] / (high * like[1] + (1 - high) * like[0])
                want.append(p)
            else:
                p = high
                want.append(np.nan)
        assert np.allclose(got[name]["p_high"], want, equal_nan=True, atol=1e-9)
    cut = series_of(regime.filtered(d.filter("pos <= 400"), params), "p_high")
    assert all(cut[k]["p_high"].equals(got[k]["p_high"].iloc[: len(cut[k])]) for k in cut)
    smooth = series_of(regime.smoothed(d, params, 1998), "p_smooth")
    short = series_of(regime.smoothed(d.filter("pos <= 400"), params, 1998), "p_smooth")
    k = min(short)
    a, b = smooth[k]["p_smooth"].iloc[: len(short[k])].to_numpy(), short[k]["p_smooth"].to_numpy()
    assert np.nanmax(np.abs(a - b)) > 1e-3  # it reads the future, so a longer series gives other values


def test_regime_member_uses_what_was_known(spark):
    d = vol.regime_observations(market.index_bars(spark, SF))
    thetas = fit.regimes(d).cache()
    labels = scoring.forecasts(market.index_bars(spark, SF)).cache()
    whole = series_of(regime.member_probabilities(d, thetas, labels), "m_h")
    early = d.filter("pos <= 900")
    cut = series_of(regime.member_probabilities(early, thetas, labels.filter("pos <= 880")), "m_h")
    met = 0
    for k, g in cut.items():
        both = g.merge(whole[k], on=[SERIES, "pos"]).dropna()
        assert np.allclose(both["m_h_x"], both["m_h_y"], atol=1e-9)
        met += len(both)
    assert met > 200


def test_macd_by_pandas(spark):
    c = walk(300, 5)
    got = folds.macd_phase(closes(spark, c)).orderBy("pos").toPandas()
    s = pd.Series(c)
    ema = lambda x, k: x.ewm(span=k, adjust=False).mean()
    macd = ema(s, 12) - ema(s, 26)
    hist = macd - ema(macd, 9)
    assert np.allclose(got["hist"], hist, atol=1e-9)
    for i in range(5, 300, 7):
        d, up, dn = hist.iloc[: i + 1].diff().dropna(), 0, 0
        for x in d.iloc[::-1]:
            if x > 0 and not dn:
                up += 1
            elif x < 0 and not up:
                dn += 1
            else:
                break
        want = "turn" if hist[i] < 0 and up >= 3 else "roll" if hist[i] > 0 and dn >= 3 else "up" if hist[i] >= 0 else "down"
        assert got["phase"][i] == want
    flat = folds.macd_phase(closes(spark, [100.0] * 40)).filter("pos = 40").first()
    assert flat["hist"] == 0 and flat["phase"] == "up"


def test_walk_forwards_by_numpy(spark):
    d = research._ladder(spark, SF)
    rows = d.select(SERIES, "pos", F.year("date").alias("year"), "y", "x_har", "x_ma", "l1", "l5", "l22", "ln_fwd").toPandas().sort_values([SERIES, "pos"])
    logit = {(r[SERIES], r["year"]): r["coef"] for r in fit.logit_walk_forward(d, ["x_har", "x_ma"]).collect()}
    ols = {(r[SERIES], r["year"]): r["coef"] for r in fit.ols_walk_forward(d, ["l1", "l5", "l22"], "ln_fwd").collect()}
    assert len(logit) > 8 and len(ols) > 8
    for (k, year), coef in list(ols.items())[:6]:
        g = rows[rows[SERIES] == k]
        past = g[g["pos"] <= g[g["year"] == year]["pos"].min() - 21].dropna(subset=["l1", "l5", "l22", "ln_fwd"])
        x = np.column_stack([np.ones(len(past)), past[["l1", "l5", "l22"]]])
        assert np.allclose(coef, np.linalg.lstsq(x, past["ln_fwd"], rcond=None)[0], atol=1e-6)
    for (k, year), coef in list(logit.items())[:6]:
        g = rows[rows[SERIES] == k]
        past = g[g["pos"] <= g[g["year"] == year]["pos"].min() - 21].dropna(subset=["x_har", "x_ma", "y"])
        x = np.column_stack([np.ones(len(past)), past[["x_har", "x_ma"]]])
        p = 1 / (1 + np.exp(-x @ coef))
        assert np.abs(x.T @ (past["y"] - p) - np.array([0, *coef[1:]])).max() < 1e-6  # gradient of the penalised likelihood


def test_bootstraps_by_a_plain_loop(spark):
    x = np.random.default_rng(4).normal(size=130)
    df = spark.createDataFrame([("A", i, float(v), float(v * v + 1)) for i, v in enumerate(x)], "series_id string, pos int, v double, w double")
    for options in ({}, {"ratio_to": "w"}, {"quantile": 0.5}):
        got = fit.block_bootstrap(df, "v", [SERIES], block=40, draws=300, seed=0, **options).first()
        rng, stats = np.random.default_rng(0), []
        starts = rng.integers(0, 130, size=(300, 4))
        for row in starts:
            at = np.concatenate([(s + np.arange(40)) % 130 for s in row])[:130]
            stats.append(np.median(x[at]) if "quantile" in options else 1 - x[at].mean() / (x[at] ** 2 + 1).mean() if options else x[at].mean())
        low, high = np.percentile(stats, [2.5, 97.5])
        assert got["low"] == pytest.approx(low) and got["high"] == pytest.approx(high)


def test_digests_agree_and_differ(spark):
    d = scoring.forecasts(market.index_bars(spark, SF)).select(SERIES, "pos", "p", "y")
    of = lambda x: {r[SERIES]: (r["digest"], r["second"]) for r in ladder.rows_digest(x, [SERIES], ["pos", "p", "y"]).collect()}
    a = of(d)
    assert a == of(d.repartition(7)) and of(d.withColumn("p", F.when(F.col("pos") == 300, F.col("p") + 1e-6).otherwise(F.col("p")))) != a


def test_admission_needs_fresh_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [("A", i, i // 40, int(rng.random() < 0.3)) for i in range(40 * 12)]
    d = spark.createDataFrame(rows, "series_id string, pos int, block int, y int")
    good = d.withColumns({"m_p2": F.lit(0.5), "m_h": F.lit(0.3), "m_m1": F.lit(0.9)})
    test = lambda m, fresh: ensemble.admission(good, m, ["p2"], fresh, draws=200).first()
    assert test("h", True)["verdict"] == "ADMIT" and test("m1", True)["verdict"] == "SHADOW"
    observed = test("h", False)
    assert observed["verdict_raw"] == "ADMIT" and observed["verdict"] == "SHADOW" and observed["reason"] == "observed_record_cannot_admit"
    few = ensemble.admission(good.filter("block < 10"), "h", ["p2"], True, draws=200).first()
    assert few["reason"] == "too_few_fresh_blocks"
    members = spark.createDataFrame([("h", "admitted", "2027-01-04"), ("m1", "admitted", None), ("p2", "seed", None)], "member string, status string, d string").select("member", "status", F.to_date("d").alias("effective"))
    got = {r["member"]: (r["status"], r["fault"]) for r in ensemble.effective_statuses(members, "2026-12-31").collect()}
    assert got == {"h": ("shadow", False), "m1": ("shadow", True), "p2": ("seed", False)}


def test_health_and_gates(spark):
    s = spark.createDataFrame([("A", "h", 0.05, 0.65), ("A", "m1", -0.01, 0.7), ("B", "h", 0.05, 0.55), ("C", "h", 0.02, 0.7)], "series_id string, member string, skill double, auc double")
    trips = spark.createDataFrame([("C", 3)], "series_id string, trips long")
    assert {(r[SERIES], r["member"]): r["reason"] for r in ensemble.member_health(s, trips).collect()} == {("A", "h"): None, ("A", "m1"): "no_skill", ("B", "h"): "auc", ("C", "h"): "guard"}
    d = spark.createDataFrame([("2024-08-30",), ("2024-09-01",)], "d string").select(F.to_date("d").alias("date"))
    assert tracking.gated(d, False).count() == 1 and tracking.gated(d, True).count() == 2


def test_guard_reasons(spark):
    sound = {**research.THETA, "share_low": 0.7, "share_high": 0.3}
    df = spark.createDataFrame([tuple(sound.values())], list(sound)).select("*", regime.guard_reasons().alias("why"))
    assert df.first()["why"] == ""
    bad = {**sound, "p00": 0.5, "mean_v1": -2.0, "share_high": 0.01, "cov_rv0": 1.0}
    assert spark.createDataFrame([tuple(bad.values())], list(bad)).select(regime.guard_reasons().alias("why")).first()["why"] == "p00,gap,share_high,cov0"


def test_known_payroll_and_expiry_dates(spark):
    got = {(r["year"], r["month"]): r["date"] for r in events.payrolls(spark, 2024, 2027).collect()}
    assert got[2025, 1] == dt.date(2025, 1, 10) and got[2025, 7] == dt.date(2025, 7, 3) and got[2026, 5] == dt.date(2026, 5, 8) and got[2024, 3] == dt.date(2024, 3, 1) and got[2027, 1] == dt.date(2027, 1, 8)
    kinds = {r["date"]: r["kind"] for r in events.all_events(spark, 2026, 2026).filter("kind in ('OPEX', 'QUAD')").collect()}
    assert kinds[dt.date(2026, 6, 18)] == "QUAD" and kinds[dt.date(2026, 4, 17)] == "OPEX" and len(kinds) == 12


def test_frames_are_stored_by_version(spark, tmp_path):
    a, b = market.index_close(spark, SF), spark.createDataFrame([(1, "x")], "k int, v string")
    root = str(tmp_path / "cache")
    feeds.save_frames({"prices": a, "notes": b}, root)
    feeds.save_frames({"prices": a.filter("pos <= 10"), "notes": b}, root)
    got = feeds.load_frames(spark, root)
    assert set(got) == {"prices", "notes"} and got["prices"].count() == a.filter("pos <= 10").count()
    path = str(tmp_path / "csv")
    feeds.write_csv(a.select(SERIES, "date", "close").limit(20), path)
    back = feeds.read_csv(spark, path, f"{SERIES} string, date date, close double")
    assert back.count() == 20 and back.filter("close is null or date is null").count() == 0


def test_split_prices(spark):
    rows = [("A", "2020-01-02", 1.0, 2.0, 0.5, 1.5, 1), ("A", "2020-01-02", 1.0, 2.0, 0.5, 1.6, 2), ("T", "2020-01-02", 9.0, 9.0, 9.0, 9.0, 3), ("A", "2020-01-01", 1.0, 1.0, 1.0, 1.0, 4), ("B", "2020-01-03", 1.0, 1.0, 1.0, None, 5)]
    raw = spark.createDataFrame(rows, "series_id string, d string, open double, high double, low double, close double, line int").withColumn("date", F.to_date("d"))
    closed, bars, missing = feeds.split_prices(raw, ["A", "B", "T"], "T")
    assert sorted((r[SERIES], str(r["date"]), r["close"]) for r in closed.collect()) == [("A", "2020-01-02", 1.6), ("T", "2020-01-02", 9.0)]
    assert bars.count() == 1 and [r[SERIES] for r in missing.collect()] == ["B"]


def test_nested_sentiment(spark):
    payload = '{"score": {"data": [{"x": 1704067200000, "y": 50}, {"x": 1704067200000, "y": 51}, {"x": null, "y": 1}]}, "momentum": {"data": [{"x": 1704153600000, "y": 3}]}}'
    got = {str(r["date"]): (r["score"], r["momentum"]) for r in feeds.sentiment(spark.createDataFrame([(payload,)], "text string"), ["momentum"]).collect()}
    assert got == {"2024-01-01": (51.0, None), "2024-01-02": (None, 3.0)}


def test_logs_and_promotion(spark):
    log = spark.createDataFrame([("2024-01-01", "D1", 1.0)], "asof string, code string, value double")
    new = spark.createDataFrame([("2024-01-01", "D1", 9.0), ("2024-01-02", "D3", 5.0), ("2024-01-02", "D3", 4.0)], log.schema)
    assert sorted(map(tuple, tracking.appended_alarms(log, new).collect())) == [("2024-01-01", "D1", 1.0), ("2024-01-02", "D3", 4.0)]
    old = spark.createDataFrame([(1, "z")], "b int, extra string")
    assert tracking.promoted(old, {"a": "string", "b": "long"}).columns == ["a", "b", "extra"] and tracking.promoted(old, {"a": "string", "b": "long"}).first()[:] == (None, 1, "z")


def test_calendar_queries_agree_with_a_loop(spark):
    days = {r["date"] for r in sessions.sessions(spark, 1994, 2003).collect()}
    got = events.around(spark.createDataFrame([(dt.date(1999, 12, 31),), (dt.date(2000, 1, 1),), (dt.date(2001, 9, 12),)], "date date"), sessions.sessions(spark, 1994, 2003)).collect()
    for r in got:
        assert r["prev_session"] == max(d for d in days if d < r["date"]) and r["next_session"] == min(d for d in days if d > r["date"]) and r["session"] == (r["date"] if r["date"] in days else None)


def test_ladder_rows_are_common_to_all_rungs(spark):
    got = catalog.queries()["ladder_rungs"](spark, SF).toPandas()
    sizes = got.groupby([SERIES, got["block"].fillna(-1)])["n"].nunique()
    assert (sizes == 1).all() and set(got["rung"]) == set(research.LADDER)


def test_cache_refuses_lost_series_and_keeps_cells(spark, tmp_path):
    from tidemark.sources import cache

    root = str(tmp_path / "prices")
    a = market.index_close(spark, SF).select(SERIES, "date", "close")
    cache.build(a, root, "S0", ("S1", "S2", "S3"))
    with pytest.raises(ValueError, match="lost"):
        cache.build(a.filter(F.col(SERIES) != "S2"), root, "S0")
    cache.build(a.filter(F.col(SERIES) != "S2"), root, "S0", ("S1", "S3"), force=True)
    new = a.filter("series_id = 'S0'").limit(3).withColumn("close", F.when(F.col("close") > 0, 7.0))
    cache.update(new.unionByName(a.filter("series_id = 'S1'").limit(2).withColumn("close", F.lit(None).cast("double"))), root, "S0", ("S1", "S3"))
    got = feeds.load_frames(spark, root)["prices"]
    assert got.filter("close = 7.0").count() == 3 and got.filter("series_id = 'S1'").count() == a.filter("series_id = 'S1'").count()


def test_draws_are_never_broadcast(spark):
    df = spark.range(90).select(F.lit("A").alias(SERIES), F.col("id").alias("pos"), F.rand(3).alias("v"))
    got = bootstrap.resampled(df, ["v"], [SERIES], 40, 300)
    assert got.count() == 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the last join is that of draws and block sums
    assert next(line for line in plan.splitlines() if "Join" in line and "start#" in line).count("ShuffledHashJoin") == 1


def test_blocks_read_the_forecasts_once(spark, monkeypatch):
    asked = []
    plain = research._rung_rows
    monkeypatch.setattr(research, "_rung_rows", lambda *a: asked.append(a) or plain(*a))
    monkeypatch.setattr(bootstrap, "interval", lambda df, value, by, **k: df.groupBy(*by).agg(F.min(value).alias("low")))
    assert catalog.queries()["amended_acceptance"](spark, SF).count() == 16
    assert len(asked) == 1


def test_state_without_rows_has_the_whole_interval(spark, monkeypatch):
    rows = spark.createDataFrame([("A", 1, 0.2, 1, "normal", 0.01, -0.06, True)], "series_id string, pos int, p double, y int, state string, ret double, mdd double, ep10 boolean")
    monkeypatch.setattr(research, "_outcomes", lambda *a: rows)
    got = {r["state"]: r for r in catalog.queries()["state_outcomes"](spark, SF).collect()}
    assert set(got) == set(scenarios.STATES) and (got["caution"]["n"], got["caution"]["wilson_low"], got["caution"]["wilson_high"]) == (0, 0.0, 1.0)
    assert got["caution"]["obs"] is None and 0 < got["normal"]["wilson_low"] < got["normal"]["wilson_high"] <= 1
