"""Queries that run as streams or keep versioned tables, beside SQL for the same rows from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES
from tidemark.operators import normalise
from tidemark.plans.queries import PX, QUERIES, _ratios, query, r6
from tidemark.sources import market, shared, versioned
from tidemark.streaming import ledger, live

_WAIT = " UNION ALL ".join(f"SELECT series_id, {h} AS horizon, bar, lead(bar, {h}) OVER w + INTERVAL 1 HOUR AS known_at, close, lead(close, {h}) OVER w / close - 1 AS fwd_ret, least(0.0, min(close) OVER (PARTITION BY series_id ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1) AS fwd_maxdd FROM b WINDOW w AS (PARTITION BY series_id ORDER BY bar)" for h in ledger.HORIZONS)


@query(f"""WITH t AS (SELECT event_type AS series_id, ts, date_trunc('hour', ts) AS bar, value FROM events WHERE value > 0), b AS (SELECT series_id, bar, CAST(last(value ORDER BY ts) AS DOUBLE) AS close FROM t GROUP BY 1, 2 HAVING bar + INTERVAL 1 HOUR <= (SELECT max(ts) FROM t) - INTERVAL 5 MINUTE),
r AS (SELECT series_id, 0 AS horizon, bar, bar + INTERVAL 1 HOUR AS known_at, close, NULL AS fwd_ret, NULL AS fwd_maxdd FROM b UNION ALL {_WAIT})
SELECT series_id, CAST(horizon AS BIGINT) AS horizon, strftime(bar, '%Y-%m-%d %H:%M:%S') AS bar, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at, {r6('close')} AS close, {r6('CAST(fwd_ret AS DOUBLE)')} AS fwd_ret, {r6('CAST(fwd_maxdd AS DOUBLE)')} AS fwd_maxdd FROM r WHERE known_at IS NOT NULL""")
def ledger_stream(spark, sf):
    """The live ledger out of a stream that is stopped in the middle and started again."""
    ticks = market.table(spark, sf, "events").filter("value > 0").select(F.col("event_type").alias(SERIES), F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = shared.folder(spark, "ledger")
    ends = ticks.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    stream = None
    for later in (False, True):
        middle = F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2 if ends["a"] else None).cast("timestamp")
        ticks.filter((F.col("ts") >= middle) if later else (F.col("ts") < middle)).write.mode("append").parquet(f"{folder}/ticks")
        stream = spark.readStream.schema(ticks.schema).parquet(f"{folder}/ticks")
        ledger.run(spark, stream, folder)
    return ledger.read(spark, folder)


def _in_slices(spark, rows, name, slices, made):
    """Runs ``made`` over a stream of rows that comes in slices (conditions), stopped and started again after each; returns what came out."""
    folder, out = shared.folder(spark, name), None
    for condition in slices:
        rows.filter(condition).write.mode("append").parquet(f"{folder}/in")
        out = made(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        out.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(*out.columns)


@query(QUERIES["decision_states"][1].replace(", CAST(ch AS BIGINT) AS changed, CAST(sum(ch) OVER (PARTITION BY series_id ORDER BY pos ROWS 251 PRECEDING) AS BIGINT) AS churn_252", ""))
def decision_stream(spark, sf):
    """The decision machine over a stream in three slices: its state is kept between them."""
    rows = shared.written(_ratios(spark, sf).select(SERIES, F.col("pos").cast("long").alias("pos"), "r"), "ratios")
    return _in_slices(spark, rows, "decisions", ("pos < 700", "pos >= 700 and pos < 701", "pos >= 701"), live.decision_stream)


@query(f"SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6('CAST(value AS DOUBLE)')} AS value FROM events")
def append_once(spark, sf):
    """Rows that come again in later slices are appended once."""
    e = market.table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return _in_slices(spark, e, "appends", ("event_id % 3 <> 0", "event_id % 2 = 0", "true"), lambda rows: live.first_only(rows, ["event_id"], "ts", "60 days"))


# ---- the cache of prices as a table in versions -----------------------------------------------------------------

BUILT, FROM, TO, TRUTH_TO = "1997-06-30", "1997-05-20", "1997-09-30", "1997-09-15"


def _cached(spark, sf):
    """A build and an update with corrections in June, missing cells, cells as they were in May, and rows that the truth series hasn't reached. Returns the folder."""
    # both fetches see the same cells: sums differ in the last place from run to run, which would count as changes
    rows = shared.written(market.index_close(spark, sf), "prices")
    root = shared.folder(spark, "cache")
    versioned.build(rows.filter(F.col("date") <= BUILT).select(SERIES, "date", "close"), root, "S0")
    moved = F.when((F.col("pos") % 10 == 0) & (F.col("date") >= "1997-06-01"), F.col("close") * 1.01).otherwise(F.col("close"))
    new = rows.filter(F.col("date").between(FROM, TO) & ((F.col(SERIES) != "S0") | (F.col("date") <= TRUTH_TO)))
    versioned.update(new.select(SERIES, "date", F.when(F.col("pos") % 13 != 0, moved).alias("close")), root, "S0")
    return root


CACHED = f"""{PX}, o AS (SELECT series_id, date, close FROM px WHERE date <= DATE '{BUILT}' AND date <= (SELECT max(date) FROM px WHERE series_id = 'S0' AND date <= DATE '{BUILT}')),
nw AS (SELECT series_id, date, CASE WHEN pos % 13 <> 0 THEN CASE WHEN pos % 10 = 0 AND date >= DATE '1997-06-01' THEN close * 1.01 ELSE close END END AS close FROM px WHERE date BETWEEN DATE '{FROM}' AND DATE '{TO}' AND (series_id <> 'S0' OR date <= DATE '{TRUTH_TO}')),
mg AS (SELECT series_id, date, coalesce(n.close, o.close) AS close FROM o FULL JOIN nw n USING (series_id, date)), tr AS (SELECT max(date) AS d FROM (SELECT date FROM o WHERE series_id = 'S0' UNION ALL SELECT date FROM nw WHERE series_id = 'S0' AND close IS NOT NULL)),
fin AS (SELECT * FROM mg WHERE close IS NOT NULL AND date <= (SELECT d FROM tr)),
df AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM nw LEFT JOIN o USING (series_id, date) WHERE nw.close IS NOT NULL AND nw.close IS DISTINCT FROM o.close)"""


@query(f"WITH {CACHED} SELECT series_id, CAST(date AS VARCHAR) AS date, {r6('close')} AS close FROM fin")
def cache_rows(spark, sf):
    """The cache after a build and an update, read back."""
    return versioned.read(spark, _cached(spark, sf))


@query(f"WITH {CACHED} SELECT strftime(date, '%Y-%m') AS month, CASE WHEN any_value(df.month) IS NULL THEN 1 ELSE 2 END AS version, count(*) AS n, CAST(max(date) AS VARCHAR) AS last_date, CAST(max(CASE WHEN series_id = 'S0' THEN date END) AS VARCHAR) AS truth_date FROM fin LEFT JOIN df ON df.month = strftime(date, '%Y-%m') GROUP BY 1")
def cache_months(spark, sf):
    """Which version holds each month: only what changed was written anew."""
    return versioned.manifest(spark, _cached(spark, sf)).drop("at")


# ---- ledger rows out of loose cells -----------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT event_id, event_id % 2 = 0 AS b2, event_id % 3 = 0 AS b3, event_id % 5 = 0 AS b5, event_id % 7 = 0 AS b7, event_id % 11 = 0 AS b11, value / 1000.0 AS p FROM events)
SELECT event_id, CASE WHEN b3 THEN 'completed' ELSE 'faithful' END AS variant, {r6('CASE WHEN b7 THEN NULL ELSE p END')} AS p, {r6('CASE WHEN b2 THEN 0.5 END')} AS w_exec, {r6('CASE WHEN b5 THEN 1.0 END')} AS flag, CASE WHEN b11 THEN NULL ELSE '{{"p2": 0.25, "M1": null, "zz": 1.0}}' END AS members, 'D1,D3' AS alarms,
concat_ws(';', CASE WHEN b5 THEN 'tone' END, CASE WHEN b7 THEN 'not_number:prob_dd5_20' END, CASE WHEN NOT b7 AND p NOT BETWEEN 0 AND 1 THEN 'chance:prob_dd5_20' END, CASE WHEN b3 THEN 'whole:p2_days_in_state' END, CASE WHEN b11 THEN 'set:p3_w_reason' END, CASE WHEN b11 THEN 'members' END) AS errors,
concat_ws(';', CASE WHEN NOT b3 THEN 'variant' END, CASE WHEN b2 THEN 'state:btc' END, CASE WHEN b7 THEN 'set:p2_band_src' END, CASE WHEN NOT b7 AND p < 0.1 - 1e-12 THEN 'outside:p2' END, CASE WHEN b7 THEN 'no_reason:p2' END, CASE WHEN b2 AND NOT b11 THEN 'weight_of_info_only' END, CASE WHEN b5 THEN 'outcome:y_dd5_20' END, CASE WHEN b3 THEN 'unknown:p3.odd' END) AS warnings FROM e""")
def normalised_rows(spark, sf):
    """Rows made of events with planted faults, under flat names, aliases and nested names."""
    e = market.table(spark, sf, "events")
    at = lambda n: F.col("event_id") % n == 0
    when = lambda c, yes, no=None: F.when(c, yes).otherwise(no)
    cells = {
        "asof": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "variant": when(at(3), "completed"), "tone": when(at(5), "calm", "hold"), **{f"state_{k}": F.lit("GREEN") for k in ("fang", "macd", "fg")}, **{f"states.{k}": F.lit("RED") for k in ("vix", "ma", "eod", "lead")},
        "states.btc": when(~at(2), "AMBER"), "p2.prob": when(at(7), "high", (F.col("value") / 1000).cast("string")), "p2_lo": F.lit("0.1"), "p2_days": when(at(3), "2.5", "3"), "p2_band_src": when(at(7), "guess", "param"), "p3_w": when(at(2), "0.5", " "),
        "p3.reason": when(at(11), "mood", "info_only"), "p3_disagree_flag": when(at(5), "True", "no"), "p3_members": when(at(11), "[1]", '{"zz": 1, "M1": null, "p2": 0.25}'), "p3_alarms": F.lit(" D3,D1 ,,D3"), "y_dd5_20": when(at(5), "1", "nan"), "p3.odd": when(at(3), "1"),
    }
    both = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in cells.items())), lambda x: x["value"].isNotNull()))
    d = normalise.normalised(e.select("event_id", both.alias("cells")))
    text = lambda c: F.array_join(c, ";").alias(c)
    return d.select("event_id", "variant", F.col("prob_dd5_20").alias("p"), F.col("p3_w_exec").alias("w_exec"), F.col("p3_disagree_flag").alias("flag"), F.col("p3_members").alias("members"), F.col("p3_alarms").alias("alarms"), text("errors"), text("warnings"))
