"""The stream of the ledger beside its batch twin, the versioned table's commits and refusals, sketches' errors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_oracle import rows
from tidemark.functions.expr import SERIES
from tidemark.operators import reference
from tidemark.plans import streams
from tidemark.sources import market, versioned
from tidemark.streaming import ledger


def test_stream_equals_batch_whatever_the_stops(spark, tmp_path):
    ticks = market.table(spark, SF, "events").filter("value > 0").select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias("ts"), "value").cache()
    want = rows(ledger.batch(ticks).toPandas())
    cuts = [None, "2024-01-05 10:20:00", "2024-01-05 10:20:01", "2024-01-20 00:00:00", None]
    folder = str(tmp_path)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = ticks.filter((F.col("ts") >= a) if a else F.lit(True)).filter((F.col("ts") < b) if b else F.lit(True))
        part.write.mode("append").parquet(f"{folder}/ticks")
        ledger.run(spark, spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks"), folder)
    got = ledger.read(spark, folder)
    assert rows(got.toPandas()) == want and want[0]
    ledger.run(spark, spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks"), folder)  # nothing new, nothing twice
    assert got.count() == len(want[0])


def prices(spark, *cells):
    return spark.createDataFrame(cells, "series_id string, d string, close double").select(SERIES, F.to_date("d").alias("date"), "close")


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert versioned.read(spark, root).count() == 0
    assert versioned.build(prices(spark, ("T", "2001-01-30", 1.0), ("T", "2001-02-27", 2.0), ("A", "2001-02-28", 9.0), ("A", "2001-01-30", 3.0), ("B", "2001-01-02", None)), root, "T") == 1
    got = lambda n=None: sorted((r[0], str(r[1]), r[2]) for r in versioned.read(spark, root, n).collect())
    first = [("A", "2001-01-30", 3.0), ("T", "2001-01-30", 1.0), ("T", "2001-02-27", 2.0)]
    assert got() == first  # the row after the truth series' last date is dropped
    assert versioned.update(prices(spark, ("A", "2001-02-28", 9.0), ("T", "2001-02-28", 2.5), ("A", "2001-01-30", 3.0), ("A", "2001-03-01", 1.0)), root, "T") == 2
    second = sorted([*first, ("A", "2001-02-28", 9.0), ("T", "2001-02-28", 2.5)])
    assert got() == second and got(1) == first
    assert {r["month"]: r["version"] for r in versioned.manifest(spark, root).collect()} == {"2001-01": 1, "2001-02": 2}
    with pytest.raises(versioned.Taken):
        versioned.commit(spark, root, 2, versioned.manifest(spark, root))
    with pytest.raises(ValueError, match="refused"):
        versioned.build(prices(spark, ("T", "2001-02-28", 2.5)), root, "T")
    assert versioned.build(prices(spark, ("T", "2001-02-28", 2.5)), root, "T", force=True) == 3
    assert got() == [("T", "2001-02-28", 2.5)] and got(2) == second


def test_an_update_opens_only_its_months(spark, tmp_path):
    root = streams._cached(spark, SF)
    months = spark.createDataFrame([("1997-06",)], "month string")
    files = versioned.read(spark, root, months=months).inputFiles()
    assert files and all("month=1997-06" in f for f in files)


def test_sketches_err_by_little(spark):
    x = np.random.default_rng(5).normal(size=200_000)
    df = spark.createDataFrame([(f"S{i % 3}", "p", float(v)) for i, v in enumerate(x)], "series_id string, panel string, value double").repartition(8)
    small = {r[SERIES]: r for r in reference.quantiles(reference.sketches(df, 400)).collect()}
    exact = {r[SERIES]: r for r in reference.quantiles(reference.sketches(df, 65_535)).collect()}
    for name, r in small.items():
        part = np.sort(x if name is None else x[int(name[1]) :: 3])
        for q in reference.QUANTILES:
            assert abs(np.searchsorted(part, r[f"p{round(100 * q):02d}"]) / len(part) - q) < 0.02
            assert abs(np.searchsorted(part, exact[name][f"p{round(100 * q):02d}"]) / len(part) - q) < 0.0005


def plain_row(cells):
    """The rules of one ledger row, cell by cell."""
    import json

    from tidemark.operators import normalise as n
    from tidemark.operators import rules

    def get(*keys):
        for k in keys:
            v = (cells.get(k) or "").strip(" ")
            if v and v.lower() != "nan":
                return v
        return None

    def number(v):
        try:
            return None if v is None else float(v)
        except ValueError:
            return None

    raw = {c: get(*n.keys_of(c)) for c in (*n.NUMBERS, *n.TEXTS, *n.SWITCHES, *n.EVENTS, "p3_members", "p3_alarms")}
    value = {c: number(raw[c]) for c in n.NUMBERS}
    errors, warnings = [], []
    if get("tone") not in rules.TONES:
        errors.append("tone")
    errors += [f"not_number:{c}" for c in n.NUMBERS if raw[c] is not None and value[c] is None]
    errors += [f"chance:{c}" for c in n.CHANCES if value[c] is not None and not 0 <= value[c] <= 1]
    errors += [f"whole:{c}" for c in n.WHOLE if value[c] is not None and (value[c] < 0 or value[c] != int(value[c]))]
    errors += [f"set:{c}" for c, ok in n.CLOSED.items() if raw[c] is not None and raw[c] not in ok]
    errors += [f"truth:{c}" for c in (*n.SWITCHES, *n.EVENTS) if raw[c] is not None and raw[c].lower() not in (*n.YES, *n.NO)]
    if raw["p3_members"] is not None:
        try:
            found = json.loads(raw["p3_members"])
            assert isinstance(found, dict) and all(v is None or 0 <= float(v) <= 1 for v in found.values())
        except (ValueError, AssertionError, TypeError):
            errors.append("members")
    p = value["prob_dd5_20"]
    if None not in (value["p3_lo"], value["p3_hi"]) and value["p3_lo"] > value["p3_hi"] + 1e-12:
        errors.append("band:p3")
    if get("variant") is None:
        warnings.append("variant")
    warnings += [f"state:{k}" for k in n.SIGNALS if get(f"state_{k}", f"states.{k}") is None]
    warnings += [f"set:{c}" for c, ok in n.OPEN.items() if raw[c] is not None and raw[c] not in ok]
    for x in ("p2", "p3"):
        low, high = value[f"{x}_lo"], value[f"{x}_hi"]
        if p is not None and (low is not None and low > p + 1e-12 or high is not None and high < p - 1e-12):
            warnings.append(f"outside:{x}")
    has = lambda x: any(k.startswith((f"{x}_", f"{x}.")) for k in cells)
    if has("p2") and p is None and raw["p2_input_missing"] is None:
        warnings.append("no_reason:p2")
    if has("p3") and value["p3_w_exec"] is None and raw["p3_w_reason"] is None and raw["p3_input_missing"] is None:
        warnings.append("no_reason:p3")
    if value["p3_w_exec"] is not None and raw["p3_w_reason"] == "info_only":
        warnings.append("weight_of_info_only")
    warnings += [f"outcome:{c}" for c in n.OUTCOMES if get(c) is not None]
    known = {k for c in raw for k in n.keys_of(c)} | set(n.OUTCOMES)
    warnings += sorted(f"unknown:{k}" for k in cells if k[:3] in ("p2_", "p3_", "p2.", "p3.") and k not in known)
    return errors, warnings, value


def test_normaliser_by_a_plain_reading(spark):
    """Random cells under random names: typed values, errors and warnings by plain rules."""
    import random

    from tidemark.operators import normalise as n

    draw, made = random.Random(7), []
    names = ["tone", "variant", *(f"state_{k}" for k in n.SIGNALS), *n.OUTCOMES[:3], "p2_oddity", "p3.nothing", *(k for c in (*n.NUMBERS, *n.TEXTS, *n.SWITCHES, *n.EVENTS, "p3_members") for k in n.keys_of(c))]
    values = ["0.2", "0.9", "1.5", "-1", "3", "x", " ", "nan", "True", "no", "hold", "info_only", "weekly", "normal", "tones", "p2", '{"H": 0.1, "a": null}', '{"H": 2}', "[]"]
    for i in range(300):
        cells = {draw.choice(names): draw.choice(values) for _ in range(draw.choice((0, 5, 40)))}
        made.append((i, {"asof": "2001-01-02", **cells}))
    rows = spark.createDataFrame(made, "k long, cells map<string,string>")
    got = {r["k"]: r for r in n.normalised(rows).collect()}
    for k, cells in made:
        errors, warnings, value = plain_row(cells)
        assert list(got[k]["errors"]) == errors and list(got[k]["warnings"]) == warnings, (cells, got[k]["errors"], errors, got[k]["warnings"], warnings)
        assert all(got[k][c] == v or v != v for c, v in value.items())
    assert n.normalised(spark.createDataFrame([(1, {"asof": "soon", "tone": "hold"})], "k long, cells map<string,string>")).first()["errors"] == ["asof"]


def test_months_keep_their_version_where_sums_differ_from_run_to_run(spark, monkeypatch):
    want = rows(streams.QUERIES["cache_months"][0](spark, SF).toPandas())
    # another last place each time a cell is computed, as sums in the order of arrival have
    shaky = F.udf(lambda v: v * (1 + random.random() * 1e-14), "double").asNondeterministic()
    plain = market.index_close
    monkeypatch.setattr(market, "index_close", lambda *a: plain(*a).withColumn("close", shaky("close")))
    assert rows(streams.QUERIES["cache_months"][0](spark, SF).toPandas()) == want


def test_normaliser_is_no_single_method(spark):
    """A fused projection of a hundred columns is a method that the JVM doesn't compile."""
    from tidemark.operators import normalise as n

    d = n.normalised(spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.create_map(F.lit("tone"), "event_type").alias("cells"))).select("event_id", "errors", "warnings")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "*(" in line and "Project" in line and "element_at" in line]
