"""Operators against brute force, hand values, and the rule that no row reads what comes after it."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import fit, folds, paths, rules, sessions, store, vol
from tidemark.streaming import live


def closes(spark, values, name="A"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(name, day + dt.timedelta(i), i + 1, float(v)) for i, v in enumerate(values)], "series_id string, date date, pos int, close double")


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    return (100 * np.exp(np.cumsum(rng.normal(0.0003, 0.012, n)))).tolist()


def test_phi_is_near_erf(spark):
    xs = [i / 7 for i in range(-40, 41)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", expr.phi(F.col("x")).alias("p")).collect()
    assert max(abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) for r in got) < 7.5e-8


def test_barrier_probability_known_values(spark):
    known = {12: 0.133, 16: 0.262, 20: 0.372, 30: 0.558, 45: 0.703}
    got = spark.createDataFrame([(float(v),) for v in known], "v double").select("v", vol.barrier_probability(F.col("v") / 100).alias("p")).collect()
    assert all(abs(r["p"] - known[int(r["v"])]) < 2e-3 for r in got)


def test_easter_and_holidays(spark):
    got = {r["y"]: r["e"] for r in sessions.years(spark, 1990, 2030).select(F.col("year").alias("y"), sessions.easter(F.col("year")).alias("e")).collect()}
    assert got[2000] == dt.date(2000, 4, 23) and got[2008] == dt.date(2008, 3, 23) and got[2019] == dt.date(2019, 4, 21) and got[2024] == dt.date(2024, 3, 31) and got[2025] == dt.date(2025, 4, 20)
    days = {r["date"] for r in sessions.holidays(spark, 2021, 2022).collect()}
    assert dt.date(2021, 12, 24) in days and dt.date(2021, 12, 31) not in days and dt.date(2022, 6, 20) in days and len(days) == 9 + 9
    n = {r["y"]: r["n"] for r in sessions.sessions(spark, 2019, 2024).groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).collect()}
    assert n[2019] == 252 and n[2020] == 253 and n[2021] == 252 and n[2022] == 251 and n[2023] == 250 and n[2024] == 252


def test_labels_match_brute_force(spark):
    c = walk(120)
    got = {r["pos"]: r for r in vol.targets(closes(spark, c)).collect()}
    for i in range(120):
        r = got[i + 1]
        if i + 20 < 120:
            low = min(0.0, min(c[i + 1 : i + 21]) / c[i] - 1)
            assert r["fwd_ret_20"] == pytest.approx(c[i + 20] / c[i] - 1) and r["fwd_maxdd_20"] == pytest.approx(low) and r["y_dd5_20"] == int(low <= -0.05)
        else:
            assert r["fwd_ret_20"] is None and r["y_dd5_20"] is None


def test_features_read_no_future(spark):
    def features(n):
        b = closes(spark, walk(260)[:n]).withColumns({"open": F.col("close") * 0.999, "high": F.col("close") * 1.01, "low": F.col("close") * 0.99})
        v = closes(spark, walk(260, 3)[:n]).select("series_id", "date", (F.col("close") / 5).alias("vix"))
        return {r["pos"]: (r["x_vix"], r["x_har"], r["x_ma"]) for r in vol.features(b, v).collect()}

    long, short = features(260), features(220)
    assert all(long[p] == short[p] for p in short)


def test_episodes_of_a_hand_path(spark):
    path = [100, 94, 100, 101, 96, 95.5, 102, 90, 80, 95, 103, 97]
    got = paths.episodes(closes(spark, path), 0.05).orderBy("peak_pos").collect()
    assert [(r["peak_pos"], r["breach_pos"], r["trough_pos"], r["recovery_pos"]) for r in got] == [(1, 2, 2, 4), (4, 6, 6, 7), (7, 8, 9, 11), (11, 12, 12, None)]


def test_decisions_dwell_and_resume(spark):
    r = [1.0, 1.6, 1.1, 1.1, 1.1, 1.1, 1.1, 2.6, None, 1.9, 1.9, 1.9, 1.9, 1.0, 1.0]
    df = spark.createDataFrame([("A", i + 1, x) for i, x in enumerate(r)], "series_id string, pos int, r double")
    whole = [(x["state"], x["days_in_state"]) for x in folds.decisions(df).orderBy("pos").collect()]
    assert [s for s, _ in whole] == ["normal", "caution", "caution", "caution", "caution", "caution", "normal", "reduce", "reduce", "reduce", "reduce", "reduce", "caution", "caution", "caution"]
    state, days = whole[7]
    rest = [(x["state"], x["days_in_state"]) for x in folds.decisions(df.filter("pos > 8"), state=state, days=days).orderBy("pos").collect()]
    assert rest == whole[8:]


def test_fold_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = closes(spark, walk(90)).unionByName(closes(spark, walk(90, 2), "B")).withColumn("r", vol.log_return())
        small = {(x["series_id"], x["pos"]): x["sigma"] for x in folds.ewma_vol(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    whole = {(x["series_id"], x["pos"]): x["sigma"] for x in folds.ewma_vol(df).collect()}
    assert small == whole and whole["A", 60] is None and whole["A", 61] is not None


def test_sizing_priorities(spark):
    rows = [(1, None, 1.0, False), (2, 0.93, 1.0, False), (3, 0.6, 1.0, False), (4, 0.6, 1.0, True), (5, 0.3, 0.5, False), (6, 0.9, 1.0, False), (7, 1.0, 1.0, True)]
    df = spark.createDataFrame([("A", *r) for r in rows], "series_id string, pos int, w_target double, mult double, week_end boolean")
    got = [(None if r["w_exec"] is None else round(r["w_exec"], 2), r["reason"]) for r in folds.sizing(df).orderBy("pos").collect()]
    assert got == [(None, "input_missing"), (0.95, "init"), (0.95, "hold"), (0.6, "weekly"), (0.3, "escalation"), (0.3, "hold"), (1.0, "weekly")]


def test_logit_and_ols_recover(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(-1 + 0.9 * x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    assert np.abs(fit.irls(x, y) - [-1, 0.9, -0.5]).max() < 0.06
    p = 1 / (1 + np.exp(-(np.column_stack([np.ones(len(x)), x]) @ fit.irls(x, y))))
    assert abs((p - y).sum()) < 1e-6  # the intercept isn't penalised


def test_em_recovers_two_regimes():
    rng, state, xs = np.random.default_rng(0), 0, []
    for _ in range(4000):
        state = int(rng.random() < (0.02 if state == 0 else 0.95))
        xs.append(rng.normal(0.05 if state == 0 else -0.1, 0.7 if state == 0 else 2.0))
    p00, p11, _, _, v0, v1 = fit.em_two_states(np.array(xs))
    assert abs(p00 - 0.98) < 0.02 and abs(p11 - 0.95) < 0.05 and abs(v0 - 0.49) < 0.1 and abs(v1 - 4) < 0.8


def test_regime_refits_learn_both_observations_of_all_years(spark):
    rng, state, rows = np.random.default_rng(0), 0, []
    for i in range(2400):
        state = int(rng.random() < (0.02 if state == 0 else 0.95))
        v = rng.normal(-2.2 if state == 0 else -1.2, 0.2)
        rows.append(("A", dt.date(2010, 1, 1) + dt.timedelta(i), i + 1, float(rng.normal(0.05, 0.7 if state == 0 else 2.0)), float(v)))
    got = fit.regimes(spark.createDataFrame(rows, "series_id string, date date, pos int, r100 double, ln_rv10 double")).orderBy("year").collect()
    assert [r["year"] for r in got] == list(range(2011, 2017)) and [r["n"] for r in got] == [(dt.date(y, 1, 1) - dt.date(2010, 1, 1)).days - 20 for y in range(2011, 2017)]
    last = got[-1]
    assert abs(last["mean_v0"] + 2.2) < 0.05 and abs(last["mean_v1"] + 1.2) < 0.05 and abs(last["var_r1"] - 4) < 0.8 and abs(last["p00"] - 0.98) < 0.02 and not last["kept_prev"]


def test_regime_refits_is_registered_on_whole_series(spark):
    from tests.conftest import SF
    from tidemark.plans import catalog
    from tidemark.sources import market

    bars = vol.regime_observations(market.index_bars(spark, SF))
    wanted = {(r["series_id"], r["year"]): r["n"] for r in fit.training(bars).dropna(subset=["r100", "ln_rv10"]).groupBy("series_id", "year").agg(F.count("*").alias("n")).filter("n >= 50").collect()}
    assert {(r["series_id"], r["year"]): r["n"] for r in catalog.queries()["regime_refits"](spark, SF).collect()} == wanted


def test_walk_forward_uses_no_late_labels(spark):
    df = closes(spark, walk(800)).withColumn("y", (F.col("pos") % 3 == 0).cast("int"))
    got = fit.training(df).groupBy("year").agg(F.max("pos").alias("last")).join(fit.refits(df), "year").collect()
    assert got and all(r["last"] == r["refit_pos"] - 21 for r in got)


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 1, 3.0, None)], "k string, d int, x double, y double")
    new = spark.createDataFrame([("b", 1, None, 9.0), ("c", 1, 5.0, 6.0)], "k string, d int, x double, y double")
    assert sorted(map(tuple, store.upsert_cells(old, new, ["k", "d"]).collect())) == [("a", 1, 1.0, 2.0), ("b", 1, 3.0, 9.0), ("c", 1, 5.0, 6.0)]
    assert sorted(map(tuple, store.upsert_rows(old, new, ["k", "d"]).collect()), key=str) == [("a", 1, 1.0, 2.0), ("b", 1, None, 9.0), ("c", 1, 5.0, 6.0)]
    led = store.append(old, new.unionByName(new), ("k", "d"))
    assert led.count() == 3 and store.append(led, new, ("k", "d")).count() == 3


def test_backfill_never_rewrites(spark):
    c = walk(60)
    led = closes(spark, c).select("series_id", F.col("date").alias("asof"), F.when(F.col("pos") == 5, 0.5).alias("fwd_ret_20"))
    got = {r["asof"]: r for r in store.backfill(led, closes(spark, c)).collect()}
    assert got[dt.date(2020, 1, 5)]["fwd_ret_20"] == 0.5 and got[dt.date(2020, 1, 1)]["fwd_ret_20"] == round(c[20] / c[0] - 1, 6) and got[dt.date(2020, 2, 29)]["fwd_ret_20"] is None


def test_decision_table_is_complete(spark):
    t = rules.decision_table(spark).collect()
    assert len({(r["m"], r["w"], r["d"]) for r in t}) == 125 and {r["rule"] for r in t} <= set(range(11)) and all(r["tone"] in rules.TONES for r in t)


def test_streams_equal_batch(spark, tmp_path):
    r = [("A", i, float(1 + (i * 7 % 20) / 10)) for i in range(1, 60)] + [("B", i, float(1 + (i * 3 % 20) / 10)) for i in range(1, 60)]
    df = spark.createDataFrame(r, "series_id string, pos long, r double")
    for k, part in enumerate((df.filter("pos <= 20"), df.filter("pos > 20 and pos <= 41"), df.filter("pos > 41"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    out = []
    for k in range(3):
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")) if k == 0 else None
        if src is not None:
            q = live.decision_stream(src).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
            q.processAllAvailable()
            q.stop()
            out = spark.sql("SELECT * FROM decided").collect()
    batch = {(x["series_id"], x["pos"]): (x["state"], x["days_in_state"]) for x in folds.decisions(df).collect()}
    assert {(x["series_id"], x["pos"]): (x["state"], x["days_in_state"]) for x in out} == batch


def test_closing_bars_stream(spark, tmp_path):
    ticks = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 10), 1.0), ("A", dt.datetime(2024, 1, 1, 15), 3.0), ("A", dt.datetime(2024, 1, 2, 9), 2.0), ("A", dt.datetime(2024, 1, 4, 9), 5.0)], "series_id string, ts timestamp, value double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    q = live.closing_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["bar"].day, r["open"], r["close"]) for r in spark.sql("SELECT * FROM closed").collect())
    assert got == [(1, 1.0, 3.0), (2, 2.0, 2.0)]
