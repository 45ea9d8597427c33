"""Each operator as a query on the driver's tables, beside DuckDB SQL that states the same independently.

``QUERIES`` maps a name to (query, SQL or None). Doubles are rounded to six places on both sides, dates are strings and
counts are 64-bit, so values can be compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.expr import SERIES
from tidemark.operators import bootstrap, fit, folds, paths, rules, scoring, sessions, store, vol
from tidemark.sources import market

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates and times as strings, whole numbers as 64 bits, truth as 0 or 1."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            r = F.round(c, 6)
            return F.when(r == 0, 0.0).otherwise(r).alias(name)  # no negative zero
        if kind == "date":
            return c.cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        return c.cast("long").alias(name) if kind in ("int", "bigint", "smallint", "tinyint", "boolean") else c

    return df.select(*(one(n, k) for n, k in df.dtypes))


def known(name: str) -> Column:
    """A whole number, -1 where it is null: so it stays whole wherever the rows go."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-1)).alias(name)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = (lambda spark, sf_dir: shown(f(spark, sf_dir)), sql)
        return f

    return add


def on_orders(column: str = "date", years: int = 0) -> Callable:
    """Over a query of dates: only those on which orders were placed (moved on by so many years), with their number."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        found, sql = QUERIES[f.__name__]

        def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
            day = F.add_months(F.to_date("o_orderdate"), 12 * years).cast("string")
            orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(day.alias(column)).agg(F.count("*").alias("n_orders"))
            return found(spark, sf_dir).join(orders, column)

        counted = f"SELECT CAST(CAST(o_orderdate AS DATE) + to_years({years}) AS DATE)::VARCHAR AS {column}, count(*) AS n_orders FROM orders GROUP BY 1"
        QUERIES[f.__name__] = joined, f"SELECT c.*, o.n_orders FROM ({sql}) c JOIN ({counted}) o USING ({column})"
        return f

    return add


def r6(x: str) -> str:
    return f"CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END"


PX = """daily AS (SELECT 'S' || (l_suppkey % 4) AS series_id, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2),
rets AS (SELECT series_id, date, 0.011 * (a - avg(a) OVER p) / stddev_samp(a) OVER p + 0.0002 AS r0 FROM daily WINDOW p AS (PARTITION BY series_id)),
px AS (SELECT series_id, date, 100 * exp(sum(r0) OVER w) AS close, row_number() OVER w AS pos FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date))"""
BARS = PX + """,
ob AS (SELECT *, coalesce(lag(close) OVER w, close) AS open, ln(close / lag(close) OVER w) AS r, close / lag(close) OVER w - 1 AS ret FROM px WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
bars AS (SELECT *, greatest(open, close) * (1 + 0.001 * (1 + pos % 5)) AS high, least(open, close) * (1 - 0.001 * (1 + pos % 3)) AS low FROM ob)"""
VAR = BARS + """,
va AS (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) + pow(ln(open / lag(close) OVER (PARTITION BY series_id ORDER BY pos)), 2), 1e-8) END AS var FROM bars),
har AS (SELECT *, """ + ", ".join(f"CASE WHEN count(var) OVER w{k} = {k} THEN sqrt(252 * greatest(avg(var) OVER w{k}, 1e-8)) END AS rv{k}" for k in (1, 5, 22)) + """
FROM va WINDOW """ + ", ".join(f"w{k} AS (PARTITION BY series_id ORDER BY pos ROWS {k - 1} PRECEDING)" for k in (1, 5, 22)) + ")"
ORD = """od AS (SELECT 'S' || (o_custkey % 4) AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS a FROM orders GROUP BY 1, 2),
orr AS (SELECT series_id, date, 0.011 * (a - avg(a) OVER p) / stddev_samp(a) OVER p + 0.0002 AS r0 FROM od WINDOW p AS (PARTITION BY series_id)),
ox AS (SELECT series_id, date, 100 * exp(sum(r0) OVER w) AS close, row_number() OVER w AS pos FROM orr WINDOW w AS (PARTITION BY series_id ORDER BY date)),
orv AS (SELECT *, pow(ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY pos)), 2) AS r2 FROM ox),
vx AS (SELECT series_id, date, CASE WHEN count(r2) OVER w = 22 THEN 100 * sqrt(252 * avg(r2) OVER w) END AS vix FROM orv WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS 21 PRECEDING))"""


def phi_sql(x: str) -> str:
    poly = "0.0"
    for c in reversed(expr.TAIL):
        poly = f"(({poly}) + ({c!r})) * t"
    return f"(SELECT CASE WHEN z >= 0 THEN 1 - q ELSE q END FROM (SELECT z, exp(-z * z / 2) * 0.3989422804014327 * ({poly}) AS q FROM (SELECT z, 1 / (1 + 0.2316419 * abs(z)) AS t FROM (SELECT ({x}) AS z))))"


def barrier_sql(v: str, dd: float = 0.05, h: int = 20, drift: bool = True, bgk: bool = False) -> str:
    s = f"(({v}) * sqrt({h} / 252.0))"
    b = f"(ln(1 - {dd}) - {'0.5826 * (' + v + ') / sqrt(252.0)' if bgk else '0.0'})"
    m = f"(-{s} * {s} / 2)" if drift else "(0.0)"
    return f"CASE WHEN ({v}) > 0 THEN {phi_sql(f'({b} - {m}) / {s}')} + exp(2 * {m} * {b} / ({s} * {s})) * {phi_sql(f'({b} + {m}) / {s}')} END"


FWD = """fw AS (SELECT *, lead(close, 20) OVER w AS c20, lead(close, 60) OVER w AS c60, lead(close, 5) OVER w AS c5,
min(close) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS m20, min(close) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS m60
FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
lab AS (SELECT *, c5 / close - 1 AS fwd_ret_5, c20 / close - 1 AS fwd_ret_20, c60 / close - 1 AS fwd_ret_60,
CASE WHEN c20 IS NOT NULL THEN least(0.0, m20 / close - 1) END AS fwd_maxdd_20, CASE WHEN c60 IS NOT NULL THEN least(0.0, m60 / close - 1) END AS fwd_maxdd_60 FROM fw)"""
OOS = VAR + ",\n" + FWD.format(src="har") + f""",
pr AS (SELECT *, CASE WHEN fwd_maxdd_20 IS NOT NULL THEN CAST(fwd_maxdd_20 <= -0.05 AS INT) END AS y, {barrier_sql('rv22')} AS p FROM lab),
cl AS (SELECT *, year(date) AS block, avg(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING) AS clim FROM pr),
oos AS (SELECT * FROM cl WHERE y IS NOT NULL AND p IS NOT NULL AND clim IS NOT NULL)"""
WILSON = "greatest(0.0, ({p} + 3.8415999999999997 / (2 * {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8415999999999997 / (4 * {n} * {n}))) / (1 + 3.8415999999999997 / {n}))", "least(1.0, ({p} + 3.8415999999999997 / (2 * {n}) + 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8415999999999997 / (4 * {n} * {n}))) / (1 + 3.8415999999999997 / {n}))"
BIN = "CASE " + " ".join(f"WHEN p {'<=' if h == 1.0 else '<'} {h} THEN {i}" for i, h in enumerate(scoring.BINS[1:])) + " END"
EPS_BODY = """,
dd0 AS (SELECT *, max(close) OVER w AS peak FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
dd1 AS (SELECT *, close / peak - 1 AS dd, CASE WHEN peak > coalesce(lag(peak) OVER (PARTITION BY series_id ORDER BY pos), 0) THEN 1 ELSE 0 END AS fresh FROM dd0),
dd2 AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS peak_no FROM dd1),
eg AS (SELECT series_id, peak_no, min(pos) AS peak_pos, min(date) AS peak_date, max(peak) AS peak, min(CASE WHEN dd <= -0.05 THEN pos END) AS breach_pos, first(date ORDER BY close, pos) AS trough_date, first(pos ORDER BY close, pos) AS trough_pos, min(dd) AS depth FROM dd2 GROUP BY 1, 2),
ep AS (SELECT * FROM (SELECT *, lead(peak_pos) OVER (PARTITION BY series_id ORDER BY peak_no) AS recovery_pos FROM eg) WHERE breach_pos IS NOT NULL)"""
EPS = BARS + EPS_BODY


# ---- bars and sources -------------------------------------------------------------------------------------------


def _bars_sql(unit: str) -> str:
    return f"""SELECT event_type AS series_id, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S') AS bar, {r6('first(value ORDER BY ts)')} AS open, {r6('max(value)')} AS high, {r6('min(value)')} AS low,
{r6('last(value ORDER BY ts)')} AS close, count(*) AS volume FROM events WHERE value > 0 GROUP BY 1, 2"""


@query(_bars_sql("day"))
def bars_daily_ohlc(spark, sf):
    return market.bars(spark, sf, "day")


@query(_bars_sql("hour"))
def bars_hourly(spark, sf):
    return market.bars(spark, sf, "hour")


@query(f"""WITH b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS bar, first(value ORDER BY ts) AS o, last(value ORDER BY ts) AS c FROM events WHERE value > 0 GROUP BY 1, 2),
l AS (SELECT series_id, CAST(bar AS DATE) AS session, max(bar) AS bar, last(o ORDER BY bar) AS o, last(c ORDER BY bar) AS c FROM b GROUP BY 1, 2)
SELECT series_id, CAST(session AS VARCHAR) AS session, {r6('o')} AS open, {r6('c')} AS close, {r6('c / o - 1')} AS ret FROM l WHERE hour(bar) >= 20 AND o > 0""")
def eod_last_bar(spark, sf):
    """The last hourly bar of each session, accepted only if it begins late enough; its return."""
    last = market.bars(spark, sf, "hour").groupBy(SERIES, F.to_date("bar").alias("session")).agg(F.max_by(F.struct("bar", "open", "close"), "bar").alias("b"))
    return last.filter((F.hour("b.bar") >= 20) & (F.col("b.open") > 0)).select(SERIES, "session", "b.open", "b.close", (F.col("b.close") / F.col("b.open") - 1).alias("ret"))


@query(f"WITH {BARS} SELECT series_id, CAST(date AS VARCHAR) AS date, pos, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close FROM bars")
def index_bars(spark, sf):
    return market.index_bars(spark, sf)


@query(f"WITH {PX} SELECT series_id, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, {r6('min(close)')} AS low, {r6('max(close)')} AS high FROM px GROUP BY 1")
def series_stats(spark, sf):
    return market.index_close(spark, sf).groupBy(SERIES).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("close").alias("low"), F.max("close").alias("high"))


@query(f"WITH {PX}, {ORD} SELECT p.series_id, CAST(p.date AS VARCHAR) AS date, {r6('v.close')} AS other FROM px p ASOF LEFT JOIN ox v ON p.series_id = v.series_id AND p.date >= v.date")
def asof_backward(spark, sf):
    return store.asof(market.index_close(spark, sf), market.other_close(spark, sf).withColumnRenamed("close", "other"), "other")


@query(f"WITH {PX}, {ORD}, j AS (SELECT p.series_id, p.date, p.pos, v.vix FROM px p LEFT JOIN vx v USING (series_id, date)) SELECT series_id, CAST(date AS VARCHAR) AS date, {r6('last_value(vix IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS 3 PRECEDING)')} AS vix FROM j")
def ffill_bounded(spark, sf):
    return vol.ffill(market.index_close(spark, sf), market.pseudo_vix(spark, sf), "vix").select(SERIES, "date", "vix")


@query(f"WITH {PX}, {ORD} SELECT coalesce(p.series_id, o.series_id) AS series_id, CAST(coalesce(p.date, o.date) AS VARCHAR) AS date, {r6('coalesce(o.close, p.close)')} AS close FROM px p FULL JOIN ox o ON p.series_id = o.series_id AND p.date = o.date")
def upsert_cells(spark, sf):
    return store.upsert_cells(market.index_close(spark, sf).select(SERIES, "date", "close"), market.other_close(spark, sf).select(SERIES, "date", "close"), [SERIES, "date"])


@query(f"WITH {PX}, {ORD} SELECT series_id, CAST(date AS VARCHAR) AS date, {r6('close')} AS close FROM (SELECT series_id, date, close FROM ox UNION ALL SELECT series_id, date, close FROM px WHERE NOT EXISTS (SELECT 1 FROM ox WHERE ox.series_id = px.series_id AND ox.date = px.date))")
def upsert_rows(spark, sf):
    return store.upsert_rows(market.index_close(spark, sf).select(SERIES, "date", "close"), market.other_close(spark, sf).select(SERIES, "date", "close"), [SERIES, "date"])


def _prices(spark, sf):
    """Both indexes as one long frame; the second ends earlier or later than the first."""
    return market.index_close(spark, sf).select(SERIES, "date", "close").unionByName(market.other_close(spark, sf).select(F.concat(F.lit("O"), SERIES).alias(SERIES), "date", "close"))


ALL = f"{PX}, {ORD}, prices AS (SELECT series_id, date, close FROM px UNION ALL SELECT 'O' || series_id, date, close FROM ox)"


@query(f"WITH {ALL} SELECT series_id, count(*) AS n, CAST(max(date) AS VARCHAR) AS last_date FROM prices WHERE date <= (SELECT max(date) FROM prices WHERE series_id = 'OS0') OR series_id = 'S3' GROUP BY 1")
def guard_phantom(spark, sf):
    return store.guard_phantom(_prices(spark, sf), "OS0", ("S3",)).groupBy(SERIES).agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


@query(f"WITH {ALL}, l AS (SELECT series_id, max(date) AS last_date FROM prices GROUP BY 1), s AS (SELECT l.series_id, last_date, (SELECT count(*) FROM prices t WHERE t.series_id = 'S0' AND t.date > l.last_date) AS lag FROM l) SELECT series_id, CAST(last_date AS VARCHAR) AS last_date, lag FROM s WHERE lag >= 3")
def stale_series(spark, sf):
    return store.stale(_prices(spark, sf), "S0")


@query(f"""WITH {ALL}, n AS (SELECT * FROM prices WHERE series_id <> 'OS1' AND (series_id <> 'S2' OR year(date) < 1998)), a AS (SELECT series_id, count(*) AS n_old, max(date) AS lo FROM prices GROUP BY 1), b AS (SELECT series_id, count(*) AS n_new, max(date) AS ln FROM n GROUP BY 1)
SELECT series_id, n_old, CAST(lo AS VARCHAR) AS last_old, coalesce(n_new, 0) AS n_new, CAST(ln AS VARCHAR) AS last_new, CASE WHEN n_new IS NULL THEN 'lost' WHEN n_new < 0.9 * n_old THEN 'shrunk' ELSE 'moved_back' END AS reason FROM a LEFT JOIN b USING (series_id) WHERE n_new IS NULL OR n_new < 0.9 * n_old OR ln < lo""")
def rebuild_regressions(spark, sf):
    old = _prices(spark, sf)
    return store.regressions(old, old.filter((F.col(SERIES) != "OS1") & ((F.col(SERIES) != "S2") | (F.year("date") < 1998)))).withColumn("n_new", F.coalesce("n_new", F.lit(0)))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf):
    """JSON payloads parsed by a schema; malformed ones give null."""
    return market.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


FOMC_SQL = repr(list(sessions.FOMC))

# ---- calendar ---------------------------------------------------------------------------------------------------

YEARS = (1996, 2026)
NTH = "(make_date(y, {m}, 1) + CAST((({dow} - dayofweek(make_date(y, {m}, 1)) + 7) % 7 + 7 * ({n} - 1)) AS INT))"
LASTD = "(last_day(make_date(y, {m}, 1)) - CAST(((dayofweek(last_day(make_date(y, {m}, 1))) - {dow} + 7) % 7) AS INT))"
OBS = "(make_date(y, {m}, {d}) + CASE dayofweek(make_date(y, {m}, {d})) WHEN 6 THEN -1 WHEN 0 THEN 1 ELSE 0 END)"
#: The same Easter by the published table-free form, stated apart from the Spark columns.
EASTER = """ea AS (SELECT y, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l, a FROM (SELECT y, a, b, c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys))),
eb AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS k FROM ea),
es AS (SELECT y, make_date(y, CAST(k // 31 AS BIGINT), CAST(k % 31 + 1 AS BIGINT)) AS easter FROM eb)"""


def _holidays_sql(first: int, last: int) -> str:
    special = ", ".join(f"(DATE '{d}')" for d in sessions.SPECIAL)
    rule = lambda name, date, where="true": f"SELECT {date} AS date, '{name}' AS name FROM ys WHERE {where}"
    parts = [
        "SELECT CASE WHEN dayofweek(make_date(y, 1, 1)) = 0 THEN make_date(y, 1, 2) ELSE make_date(y, 1, 1) END AS date, 'new_year' AS name FROM ys WHERE dayofweek(make_date(y, 1, 1)) <> 6",
        rule("mlk", NTH.format(m=1, dow=1, n=3), "y >= 1998"), rule("presidents", NTH.format(m=2, dow=1, n=3)), "SELECT easter - 2 AS date, 'good_friday' AS name FROM es", rule("memorial", LASTD.format(m=5, dow=1)),
        rule("juneteenth", OBS.format(m=6, d=19), "y >= 2022"), rule("independence", OBS.format(m=7, d=4)), rule("labor", NTH.format(m=9, dow=1, n=1)), rule("thanksgiving", NTH.format(m=11, dow=4, n=4)), rule("christmas", OBS.format(m=12, d=25)),
        f"SELECT d AS date, 'special' AS name FROM (VALUES {special}) t(d) WHERE year(d) BETWEEN {first} AND {last}",
    ]
    return f"ys AS (SELECT unnest(range({first}, {last + 1})) AS y), {EASTER}, hol AS (" + " UNION ALL ".join(parts) + ")"


@on_orders()
@query(f"WITH {_holidays_sql(*YEARS)} SELECT CAST(date AS VARCHAR) AS date, name FROM hol")
def holidays_rule_table(spark, sf):
    return sessions.holidays(spark, *YEARS)


SESS = _holidays_sql(1995, 2002) + """, dd AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
op AS (SELECT date FROM dd WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN (SELECT date FROM hol)),
sn AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, lead(date) OVER (ORDER BY date) AS nx FROM op),
ss AS (SELECT date, pos, date_trunc('week', nx + 2) <> date_trunc('week', date + 2) AS is_week_end, month(nx) <> month(date) AS is_month_end FROM sn WHERE year(date) <= 2001)"""


@on_orders()
@query(f"WITH {SESS} SELECT CAST(date AS VARCHAR) AS date, pos, CAST(is_week_end AS BIGINT) AS is_week_end, CAST(is_month_end AS BIGINT) AS is_month_end FROM ss")
def session_calendar(spark, sf):
    return sessions.sessions(spark, 1995, 2001)


@on_orders()
@query(f"WITH {_holidays_sql(*YEARS)}, mo AS (SELECT y, unnest(range(1, 13)) AS m FROM ys), fr AS (SELECT y, m, {NTH.format(m='m', dow=5, n=3)} AS f FROM mo) SELECT y AS year, m AS month, CAST(CASE WHEN f IN (SELECT date FROM hol) THEN f - 1 ELSE f END AS VARCHAR) AS date, CAST(m IN (3, 6, 9, 12) AS BIGINT) AS quad FROM fr")
def opex_calendar(spark, sf):
    return sessions.opex(spark, *YEARS)


@on_orders("event_date", 30)
@query(f"WITH {_holidays_sql(2025, 2028)}, dd AS (SELECT CAST(unnest(generate_series(DATE '2025-01-01', DATE '2028-12-31', INTERVAL 1 DAY)) AS DATE) AS date), sn AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM dd WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN (SELECT date FROM hol)), fm AS (SELECT CAST(unnest({sessions.FOMC!r}) AS DATE) AS event_date), e AS (SELECT event_date, (SELECT min(pos) FROM sn WHERE date >= event_date) AS pos FROM fm), a AS (SELECT max(pos) AS p0 FROM sn WHERE date <= DATE '2026-03-01') SELECT 'FOMC' AS kind, CAST(event_date AS VARCHAR) AS event_date, pos - p0 AS sessions_ahead FROM e, a WHERE pos BETWEEN p0 + 1 AND p0 + 60")
def upcoming_events(spark, sf):
    events = spark.createDataFrame([("FOMC", d) for d in sessions.FOMC], "kind string, d string").select("kind", F.to_date("d").alias("date"))
    return sessions.upcoming(events, sessions.sessions(spark, 2025, 2027), "2026-03-01", 60)


WEEK = "(CAST(date_trunc('week', date + 2) AS DATE) + 4)"


@query(f"WITH {PX} SELECT series_id, CAST({WEEK} AS VARCHAR) AS label, {r6('last(close ORDER BY date)')} AS close, CAST(max(date) AS VARCHAR) AS last_date FROM px GROUP BY 1, 2")
def resample_weekly_last(spark, sf):
    return sessions.resample(market.index_close(spark, sf), sessions.week(F.col("date")), completed=False)


@query(f"WITH {PX}, b AS (SELECT series_id, last_day(date) AS label, last(close ORDER BY date) AS close, max(date) AS last_date FROM px GROUP BY 1, 2) SELECT series_id, CAST(label AS VARCHAR) AS label, {r6('close')} AS close, CAST(last_date AS VARCHAR) AS last_date FROM b x WHERE label < (SELECT max(label) FROM b y WHERE y.series_id = x.series_id)")
def resample_monthly_completed(spark, sf):
    return sessions.resample(market.index_close(spark, sf), F.last_day("date"), completed=True)


@query(f"WITH {PX}, n AS (SELECT *, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS nx FROM px) SELECT series_id, CAST(date AS VARCHAR) AS date, coalesce(CAST(date_trunc('week', nx + 2) <> date_trunc('week', date + 2) AS BIGINT), -1) AS is_week_end, coalesce(CAST(last_day(nx) <> last_day(date) AS BIGINT), -1) AS is_month_end FROM n")
def period_end_flags(spark, sf):
    return sessions.period_ends(market.index_close(spark, sf)).select(SERIES, "date", known("is_week_end"), known("is_month_end"))


# ---- volatility, features, labels -------------------------------------------------------------------------------


@query(f"WITH {VAR} SELECT series_id, pos, {r6('r')} AS r, {r6('1e4 * var')} AS gk, {r6('1e4 * greatest(pow(ln(high / low), 2) / (4 * ln(2)), 1e-8)')} AS pk, {r6('1e4 * CASE WHEN r IS NOT NULL THEN greatest(r * r, 1e-8) END')} AS cc FROM har")
def variance_estimators(spark, sf):
    b = market.index_bars(spark, sf)
    return b.select(SERIES, "pos", vol.log_return().alias("r"), (1e4 * vol.garman_klass()).alias("gk"), (1e4 * vol.parkinson()).alias("pk"), (1e4 * vol.close_to_close()).alias("cc"))


@query(f"WITH {VAR} SELECT series_id, pos, {r6('rv1')} AS rv1, {r6('rv5')} AS rv5, {r6('rv22')} AS rv22, {r6('(ln(rv1) + ln(rv5) + ln(rv22)) / 3')} AS har FROM har")
def har_components(spark, sf):
    h = vol.har_components(market.index_bars(spark, sf), vol.garman_klass())
    return h.select(SERIES, "pos", "rv1", "rv5", "rv22", vol.har_log_vol().alias("har"))


@query(f"""WITH {BARS} SELECT series_id, pos, {r6('close / CASE WHEN count(*) OVER w180 = 180 THEN avg(close) OVER w180 END - 1')} AS ma, {r6('CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 END * sqrt(252.0)')} AS rv20,
{r6('CASE WHEN count(r) OVER f20 = 20 AND stddev_samp(r) OVER f20 > 0 THEN ln(stddev_samp(r) OVER f20 * sqrt(252.0)) END')} AS ln_rv_fwd FROM bars
WINDOW w180 AS (PARTITION BY series_id ORDER BY pos ROWS 179 PRECEDING), w20 AS (PARTITION BY series_id ORDER BY pos ROWS 19 PRECEDING), f20 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""")
def trend_and_realized_vol(spark, sf):
    d = market.index_bars(spark, sf).withColumn("r", vol.log_return())
    return d.select(SERIES, "pos", vol.sma_distance().alias("ma"), vol.realized_vol(F.col("r")).alias("rv20"), vol.har_target(F.col("r")).alias("ln_rv_fwd"))


@query(f"WITH {VAR} SELECT series_id, pos, {r6(barrier_sql('rv22'))} AS p, {r6(barrier_sql('rv22', drift=False))} AS p_driftless, {r6(barrier_sql('rv22', bgk=True))} AS p_bgk, {r6(barrier_sql('rv22', dd=0.1, h=60))} AS p_10_60 FROM har")
def barrier_probability(spark, sf):
    h, v = vol.har_components(market.index_bars(spark, sf), vol.garman_klass()), F.col("rv22")
    return h.select(SERIES, "pos", vol.barrier_probability(v).alias("p"), vol.barrier_probability(v, drift=False).alias("p_driftless"), vol.barrier_probability(v, bgk=True).alias("p_bgk"), vol.barrier_probability(v, 0.1, 60).alias("p_10_60"))


@query(f"""WITH {VAR}, {ORD}, j AS (SELECT h.*, v.vix AS v0 FROM har h LEFT JOIN vx v USING (series_id, date)),
f AS (SELECT *, last_value(v0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS 3 PRECEDING) AS vix, close / CASE WHEN count(*) OVER w180 = 180 THEN avg(close) OVER w180 END - 1 AS x_ma FROM j WINDOW w180 AS (PARTITION BY series_id ORDER BY pos ROWS 179 PRECEDING)),
g AS (SELECT *, {barrier_sql('vix / 100')} AS p_vix, {barrier_sql('vix / 100', bgk=True)} AS p_bgk FROM f)
SELECT series_id, CAST(date AS VARCHAR) AS date, pos, {r6('vix')} AS vix, {r6('rv1')} AS rv1, {r6('rv5')} AS rv5, {r6('rv22')} AS rv22, {r6('p_vix')} AS p_vix, {r6('p_bgk')} AS p_bgk,
{r6('CASE WHEN p_vix IS NOT NULL THEN ln(least(greatest(p_vix, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_vix, 1e-6), 1 - 1e-6))) END')} AS x_vix, {r6('(ln(rv1) + ln(rv5) + ln(rv22)) / 3')} AS x_har, {r6('x_ma')} AS x_ma FROM g""")
def feature_frame(spark, sf):
    f = vol.features(market.index_bars(spark, sf), market.pseudo_vix(spark, sf))
    return f.select(SERIES, "date", "pos", "vix", "rv1", "rv5", "rv22", "p_vix", "p_bgk", "x_vix", "x_har", "x_ma")


@query(f"""WITH {BARS}, {FWD.format(src='bars')}, v AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END * sqrt(252.0) AS rv20 FROM lab WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS 19 PRECEDING)),
m AS (SELECT *, CASE WHEN count(rv20) OVER w = 252 THEN median(rv20) OVER w END AS ref, lead(rv20, 20) OVER (PARTITION BY series_id ORDER BY pos) AS nx FROM v WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS 251 PRECEDING))
SELECT series_id, pos, {r6('fwd_ret_5')} AS fwd_ret_5, {r6('fwd_ret_20')} AS fwd_ret_20, {r6('fwd_ret_60')} AS fwd_ret_60, coalesce(CAST(fwd_ret_20 > 0 AS BIGINT), -1) AS y_sign_20, {r6('fwd_maxdd_20')} AS fwd_maxdd_20, {r6('fwd_maxdd_60')} AS fwd_maxdd_60,
coalesce(CAST(fwd_maxdd_20 <= -0.05 AS BIGINT), -1) AS y_dd5_20, coalesce(CAST(fwd_maxdd_60 <= -0.10 AS BIGINT), -1) AS y_dd10_60, coalesce(CAST(nx > ref AS BIGINT), -1) AS y_vol_20 FROM m""")
def forward_labels(spark, sf):
    t = vol.targets(market.index_close(spark, sf))
    return t.select(SERIES, "pos", "fwd_ret_5", "fwd_ret_20", "fwd_ret_60", known("y_sign_20"), "fwd_maxdd_20", "fwd_maxdd_60", known("y_dd5_20"), known("y_dd10_60"), known("y_vol_20"))


@query(f"WITH {BARS}, {FWD.format(src='bars')} SELECT series_id, year(date) AS year, count(fwd_maxdd_20) AS n, {r6('avg(CAST(fwd_maxdd_20 <= -0.05 AS INT))')} AS base_rate FROM lab GROUP BY 1, 2")
def base_rates(spark, sf):
    t = vol.targets(market.index_close(spark, sf))
    return t.groupBy(SERIES, F.year("date").alias("year")).agg(F.count("y_dd5_20").alias("n"), F.avg("y_dd5_20").alias("base_rate"))


@query(f"""WITH {VAR}, k AS (SELECT a.series_id, a.pos, count(b.rv22) AS n, count(*) FILTER (b.rv22 < a.rv22) AS lt, count(*) FILTER (b.rv22 = a.rv22) AS eq FROM har a JOIN har b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos - 251 AND a.pos WHERE a.rv22 IS NOT NULL GROUP BY 1, 2)
SELECT h.series_id, h.pos, {r6('CASE WHEN n >= 60 THEN (lt + (eq + 1) / 2.0) / n END')} AS rank FROM har h LEFT JOIN k USING (series_id, pos)""")
def percentile_rank_rolling(spark, sf):
    h = vol.har_components(market.index_bars(spark, sf), vol.garman_klass())
    return h.select(SERIES, "pos", vol.percentile_rank("rv22").alias("rank"))


@query(f"""WITH {VAR}, k AS (SELECT a.series_id, a.pos, count(b.rv22) AS n, count(*) FILTER (b.rv22 < a.rv22) AS lt, count(*) FILTER (b.rv22 = a.rv22) AS eq FROM har a JOIN har b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos - 2519 AND a.pos WHERE a.rv22 IS NOT NULL GROUP BY 1, 2)
SELECT h.series_id, h.pos, {r6('CASE WHEN n >= 252 THEN (lt + (eq + 1) / 2.0) / n END')} AS rank FROM har h LEFT JOIN k USING (series_id, pos)""")
def percentile_rank_ten_years(spark, sf):
    """The reference's window; the one above has the window of its SQL."""
    h = vol.har_components(market.index_bars(spark, sf), vol.garman_klass())
    return h.select(SERIES, "pos", vol.percentile_rank("rv22", 2520, 252).alias("rank"))


# ---- scoring ----------------------------------------------------------------------------------------------------


def _oos(spark, sf):
    return scoring.forecasts(market.index_bars(spark, sf))


@query(f"WITH {OOS} SELECT series_id, coalesce(block, -1) AS block, count(*) AS n, {r6('avg(pow(p - y, 2))')} AS brier, {r6('avg(pow(clim - y, 2))')} AS brier_clim, {r6('avg(p) - avg(y)')} AS bias, {r6('1 - avg(pow(p - y, 2)) / nullif(avg(pow(clim - y, 2)), 0)')} AS skill FROM oos GROUP BY GROUPING SETS ((series_id, block), (series_id))")
def brier_blocks(spark, sf):
    return scoring.block_scores(_oos(spark, sf)).withColumn("block", known("block"))


AUC = """, rk AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0 AS rnk FROM {src}),
ra AS (SELECT {by}, count(*) AS n, sum(y) AS pos, sum(CASE WHEN y = 1 THEN rnk END) AS rs FROM rk GROUP BY ALL)
"""


@query(f"WITH {OOS}{AUC.format(by='series_id', s='p', src='oos')} SELECT series_id, n, CAST(pos AS BIGINT) AS pos, {r6('(rs - pos * (pos + 1) / 2.0) / nullif(pos * (n - pos), 0)')} AS auc FROM ra")
def auc_rank(spark, sf):
    return scoring.auc(_oos(spark, sf), "p", [SERIES])


@query(f"WITH {OOS}{AUC.format(by='series_id, block', s='rv22', src='oos')} SELECT series_id, block, n, CAST(pos AS BIGINT) AS pos, {r6('(coalesce(rs, 0) - pos * (pos + 1) / 2.0) / nullif(pos * (n - pos), 0)')} AS auc FROM ra")
def era_auc(spark, sf):
    return scoring.auc(_oos(spark, sf), "rv22", [SERIES, "block"])


@query(f"WITH {OOS}, b AS (SELECT series_id, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS o FROM oos GROUP BY 1, 2) SELECT series_id, bin, n, {r6('n / 20.0')} AS n_eff, {r6('mp')} AS mean_p, {r6('o')} AS observed, {r6(WILSON[0].format(p='o', n='(n / 20.0)'))} AS low, {r6(WILSON[1].format(p='o', n='(n / 20.0)'))} AS high FROM b")
def reliability_bins(spark, sf):
    return scoring.reliability(_oos(spark, sf), [SERIES])


@query(f"""WITH {OOS}, b AS (SELECT series_id, {BIN} AS bin, count(*) AS n, avg(p) AS f, avg(y) AS o FROM oos GROUP BY 1, 2), t AS (SELECT series_id, sum(n * o) / sum(n) AS base FROM b GROUP BY 1)
SELECT series_id, CAST(sum(n) AS BIGINT) AS n, {r6('sum(n * pow(f - o, 2)) / sum(n)')} AS reliability, {r6('sum(n * pow(o - base, 2)) / sum(n)')} AS resolution, {r6('max(base) * (1 - max(base))')} AS uncertainty FROM b JOIN t USING (series_id) GROUP BY 1""")
def murphy(spark, sf):
    return scoring.murphy(_oos(spark, sf), [SERIES])


@query(f"WITH {OOS} SELECT series_id, (pos - 1) % 20 AS phase, count(*) AS n, {r6('1 - avg(pow(p - y, 2)) / nullif(avg(pow(clim - y, 2)), 0)')} AS skill FROM oos GROUP BY 1, 2")
def phase_offsets(spark, sf):
    return scoring.phase_offsets(_oos(spark, sf))


@query(f"WITH {OOS}, s AS (SELECT series_id, (pos - 1) % 20 AS phase, 1 - avg(pow(p - y, 2)) / nullif(avg(pow(clim - y, 2)), 0) AS skill FROM oos GROUP BY 1, 2) SELECT series_id, {r6('min(skill)')} AS low, {r6('median(skill)')} AS median, {r6('max(skill)')} AS high, {r6('avg(CAST(skill > 0 AS DOUBLE))')} AS share_positive FROM s GROUP BY 1")
def phase_summary(spark, sf):
    return scoring.phase_summary(_oos(spark, sf))


@query(f"""WITH {OOS}, d AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i, pow(p - y, 2) - pow(clim - y, 2) AS d FROM oos), e AS (SELECT series_id, i, d, d - avg(d) OVER (PARTITION BY series_id) AS e FROM d),
c AS (SELECT a.series_id, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 20.0) END * a.e * b.e) AS s FROM e a JOIN e b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 0 AND 19 GROUP BY 1)
SELECT e.series_id, count(*) AS n, {r6('avg(d)')} AS mean_diff, {r6('avg(d) / (sqrt(max(s)) / count(*))')} AS t FROM e JOIN c USING (series_id) GROUP BY 1""")
def dm_test(spark, sf):
    return scoring.dm_test(_oos(spark, sf))


@query(f"""WITH {OOS}, q AS (SELECT series_id, ln(1 + fwd_ret_20) AS lr, rv22 * sqrt(20 / 252.0) AS s FROM oos WHERE fwd_ret_20 IS NOT NULL), g AS (SELECT series_id, count(*) AS n, avg(CAST(abs(lr) <= s AS DOUBLE)) AS a, avg(CAST(abs(lr) <= 1.2816 * s AS DOUBLE)) AS b, avg(CAST(abs(lr) <= 1.645 * s AS DOUBLE)) AS c, avg(CAST(lr < -1.645 * s AS DOUBLE)) AS l FROM q GROUP BY 1)
SELECT series_id, n, {r6('a')} AS in_1s, {r6('b')} AS in_80, {r6('c')} AS in_90, {r6('l')} AS left_tail, {r6(WILSON[0].format(p='a', n='(n / 20.0)'))} AS low_1s, {r6(WILSON[1].format(p='a', n='(n / 20.0)'))} AS high_1s FROM g""")
def coverage_bands(spark, sf):
    return scoring.coverage(_oos(spark, sf))


# ---- episodes, runs, allocation ---------------------------------------------------------------------------------


@query(f"WITH {EPS} SELECT series_id, CAST(peak_no AS BIGINT) AS peak_no, peak_pos, CAST(peak_date AS VARCHAR) AS peak_date, {r6('peak')} AS peak, breach_pos, CAST(trough_date AS VARCHAR) AS trough_date, trough_pos, {r6('depth')} AS depth, coalesce(recovery_pos, -1) AS recovery_pos, trough_pos - peak_pos AS to_trough, coalesce(recovery_pos - trough_pos, -1) AS to_recovery, {r6('depth + 0.05')} AS extra FROM ep")
def episodes_nosplit(spark, sf):
    return paths.episodes(market.index_close(spark, sf), 0.05).withColumns({c: known(c) for c in ("recovery_pos", "to_recovery")})


@query(f"WITH {EPS} SELECT series_id, count(*) AS n5, count(*) FILTER (depth <= -0.10) AS n10, count(*) FILTER (depth <= -0.15) AS n15, {r6('avg(CAST(depth <= -0.10 AS DOUBLE))')} AS p10, {r6('quantile_cont(depth, 0.5)')} AS depth_median, {r6('quantile_cont(to_trough, 0.5)')} AS days_median FROM (SELECT *, trough_pos - peak_pos AS to_trough FROM ep) GROUP BY 1")
def episode_conditionals(spark, sf):
    e, deep = paths.episodes(market.index_close(spark, sf), 0.05), lambda x: F.col("depth") <= -x
    return e.groupBy(SERIES).agg(F.count("*").alias("n5"), F.count_if(deep(0.10)).alias("n10"), F.count_if(deep(0.15)).alias("n15"), F.avg(deep(0.10).cast("double")).alias("p10"), F.percentile("depth", 0.5).alias("depth_median"), F.percentile("to_trough", 0.5).alias("days_median"))


@query(f"WITH {EPS} SELECT series_id, {r6('last(peak ORDER BY pos)')} AS ath, {r6('last(dd ORDER BY pos)')} AS dd, {r6('min(dd)')} AS worst, count(*) FILTER (dd <= -0.10) AS deep FROM dd2 GROUP BY 1")
def current_drawdown(spark, sf):
    d = paths.drawdown(market.index_close(spark, sf))
    return d.groupBy(SERIES).agg(F.max_by("peak", "pos").alias("ath"), F.max_by("dd", "pos").alias("dd"), F.min("dd").alias("worst"), F.count_if(F.col("dd") <= -0.10).alias("deep"))


RUNS = BARS + """, fl AS (SELECT series_id, pos, CAST(close >= open AS INT) AS up FROM bars), ch AS (SELECT *, CASE WHEN up = lag(up) OVER w THEN 0 ELSE 1 END AS c FROM fl WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ch)"""


def _ups(spark, sf):
    return market.index_bars(spark, sf).withColumn("up", (F.col("close") >= F.col("open")).cast("int"))


@query(f'WITH {RUNS} SELECT series_id, CAST(run AS BIGINT) AS run, CAST(up AS BIGINT) AS up, min(pos) AS "begin", max(pos) AS "end", count(*) AS length FROM rn GROUP BY 1, 2, 3')
def run_lengths(spark, sf):
    return paths.run_lengths(_ups(spark, sf), "up")


@query(f"WITH {RUNS} SELECT series_id, pos, CAST(sum(c) OVER (PARTITION BY series_id ORDER BY pos ROWS 251 PRECEDING) AS BIGINT) AS churn FROM ch")
def churn_252(spark, sf):
    change = F.when(F.col("up").eqNullSafe(F.lag("up").over(expr.series())), 0).otherwise(1)
    return _ups(spark, sf).withColumn("c", change).select(SERIES, "pos", paths.churn(F.col("c")).alias("churn"))


def _weights(spark, sf):
    """Weight 1 at or above the 20-day mean, else 0.5."""
    d = market.index_bars(spark, sf)
    m = expr.full(F.col("close"), F.avg("close"), expr.trailing(20), 20)
    return paths.allocation(d.withColumn("w", F.when(m.isNull() | (F.col("close") >= m), 1.0).otherwise(0.5)), "w")


ALLOC = BARS + """, w0 AS (SELECT *, CASE WHEN count(*) OVER w < 20 OR close >= avg(close) OVER w THEN 1.0 ELSE 0.5 END AS wt FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS 19 PRECEDING)),
al AS (SELECT *, CAST((1 + lag(wt) OVER w * ret) * (1 - 5.0 / 10000 * abs(coalesce(lag(wt) OVER w - lag(wt, 2) OVER w, 0.0))) - 1 AS DOUBLE) AS rule_ret FROM w0 WINDOW w AS (PARTITION BY series_id ORDER BY pos))"""


@query(f"""WITH {ALLOC}, ok AS (SELECT * FROM al WHERE rule_ret IS NOT NULL), we AS (SELECT *, exp(sum(ln(1 + rule_ret)) OVER (PARTITION BY series_id ORDER BY pos)) AS wealth FROM ok), fa AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY series_id ORDER BY pos)) - 1 AS fall FROM we),
mo AS (SELECT series_id, date_trunc('month', date) AS m, exp(sum(ln(1 + rule_ret))) AS g FROM ok GROUP BY 1, 2), me AS (SELECT series_id, min(g) - 1 AS wm, max(g) - 1 AS bm FROM mo GROUP BY 1)
SELECT series_id, count(*) AS n, {r6('exp(sum(ln(1 + rule_ret))) - 1')} AS total, {r6('exp(sum(ln(1 + rule_ret)) * 252 / count(*)) - 1')} AS cagr, {r6('stddev_samp(rule_ret) * sqrt(252.0)')} AS ann_vol, {r6('min(fall)')} AS max_dd, {r6('max(wm)')} AS worst_month, {r6('max(bm)')} AS best_month FROM fa JOIN me USING (series_id) GROUP BY 1""")
def allocation_perf(spark, sf):
    return paths.performance(_weights(spark, sf), "rule_ret")


@query(f"""WITH {ALLOC}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS k FROM al WHERE rule_ret IS NOT NULL AND ret IS NOT NULL), g AS (SELECT series_id, k // 63 AS wn, count(*) AS n, exp(sum(ln(1 + rule_ret))) - exp(sum(ln(1 + ret))) AS diff FROM k GROUP BY 1, 2)
SELECT series_id, count(*) AS windows, {r6('quantile_cont(diff, 0.1)')} AS p10, {r6('quantile_cont(diff, 0.5)')} AS p50, {r6('quantile_cont(diff, 0.9)')} AS p90, {r6('avg(CAST(diff < 0 AS DOUBLE))')} AS share_behind FROM g WHERE n = 63 GROUP BY 1""")
def rolling_relative(spark, sf):
    return paths.rolling_relative(_weights(spark, sf), "rule_ret", "ret", 63)


@query(f"WITH {ALLOC} SELECT series_id, year(date) AS year, count(*) AS n, {r6('exp(sum(ln(1 + rule_ret))) - exp(sum(ln(1 + ret)))')} AS diff FROM al WHERE rule_ret IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2")
def calendar_year_relative(spark, sf):
    return paths.calendar_relative(_weights(spark, sf), "rule_ret", "ret")


@query(f"""WITH {BARS}, k AS (SELECT *, row_number() OVER w - 1 AS k FROM bars WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY pos)), g AS (SELECT series_id, k, count(*) OVER f AS n, exp(sum(ln(1 + ret)) OVER f) - 1 AS g FROM k WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 125 FOLLOWING))
SELECT series_id, count(*) AS windows, {r6('quantile_cont(g, 0.05)')} AS p05, {r6('quantile_cont(g, 0.5)')} AS p50, {r6('quantile_cont(g, 0.95)')} AS p95, {r6('avg(CAST(g < 0 AS DOUBLE))')} AS share_negative FROM g WHERE n = 126 AND k % 21 = 0 GROUP BY 1""")
def window_distribution(spark, sf):
    return paths.window_distribution(_weights(spark, sf), "ret", 126)


@query(f"""WITH {ALLOC}{EPS_BODY} SELECT a.series_id, CAST(e.peak_no AS BIGINT) AS peak_no, count(*) AS n, {r6('exp(sum(ln(1 + coalesce(rule_ret, 0)))) - 1')} AS rule, {r6('exp(sum(ln(1 + coalesce(ret, 0)))) - 1')} AS hold, {r6('exp(sum(ln(1 + coalesce(rule_ret, 0)))) - exp(sum(ln(1 + coalesce(ret, 0))))')} AS saved
FROM al a JOIN ep e ON a.series_id = e.series_id AND a.pos > e.peak_pos AND a.pos <= e.trough_pos GROUP BY 1, 2""")
def episode_pnl(spark, sf):
    return paths.episode_returns(_weights(spark, sf), paths.episodes(market.index_close(spark, sf), 0.05), "rule_ret", "ret")


# ---- rule engine ------------------------------------------------------------------------------------------------


def _metrics(spark, sf):
    """Metrics of the rule engine derived from the two indexes; null sentiment on every seventh session."""
    d = vol.ffill(market.index_close(spark, sf), market.pseudo_vix(spark, sf), "vix")
    ret = lambda k: 100 * (F.col("close") / F.lag("close", k).over(expr.series()) - 1)
    up = F.when(F.col("close") > F.lag("close").over(expr.series()), 1).otherwise(0)
    d = d.withColumns({"ma": 100 * vol.sma_distance(20), "rs": ret(5), "mom": ret(7), "up": up})
    d = d.withColumns({"streak": F.sum("up").over(expr.trailing(5)), "vix_chg": F.col("vix") - F.lag("vix", 5).over(expr.series())})
    fg = F.when(F.col("pos") % 7 != 0, (F.col("pos") * 13 % 101).cast("double"))
    phase = F.element_at(F.array(*map(F.lit, ("down", "turn", "up", "roll"))), (F.col("pos") % 4 + 1).cast("int"))
    out = d.select(SERIES, "date", "pos", "close", "ma", "rs", "vix", "vix_chg", "streak", fg.alias("fg"), (F.col("pos") % 5 - 2).alias("fg_chg"), phase.alias("phase"), (F.col("streak") + 1).alias("leaders"), F.col("mom").alias("btc_mom"), F.col("streak").alias("btc_up"))
    return out.dropna(subset=["ma", "rs", "vix", "vix_chg", "btc_mom"])


METRICS = BARS + ", " + ORD + """, jv AS (SELECT b.*, v.vix AS v0 FROM bars b LEFT JOIN vx v USING (series_id, date)), j2 AS (SELECT *, last_value(v0 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS 3 PRECEDING) AS vix, CASE WHEN close > lag(close) OVER (PARTITION BY series_id ORDER BY pos) THEN 1 ELSE 0 END AS up FROM jv),
j3 AS (SELECT *, 100 * (close / CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END - 1) AS ma, 100 * (close / lag(close, 5) OVER w - 1) AS rs, 100 * (close / lag(close, 7) OVER w - 1) AS mom, sum(up) OVER w5 AS streak, vix - lag(vix, 5) OVER w AS vix_chg FROM j2
WINDOW w AS (PARTITION BY series_id ORDER BY pos), w20 AS (PARTITION BY series_id ORDER BY pos ROWS 19 PRECEDING), w5 AS (PARTITION BY series_id ORDER BY pos ROWS 4 PRECEDING)),
mt AS (SELECT *, CASE WHEN pos % 7 <> 0 THEN pos * 13 % 101 END AS fg, pos % 5 - 2 AS fg_chg, ['down', 'turn', 'up', 'roll'][pos % 4 + 1] AS phase, streak + 1 AS leaders, mom AS btc_mom, streak AS btc_up, ma <= 0 AS b FROM j3 WHERE ma IS NOT NULL AND rs IS NOT NULL AND vix IS NOT NULL AND vix_chg IS NOT NULL AND mom IS NOT NULL),
st AS (SELECT series_id, date, pos,
CASE WHEN b AND rs >= 1.5 THEN 'R2G' WHEN b AND rs <= -1.5 THEN 'RED' WHEN b THEN 'AMBER' WHEN rs <= -2 THEN 'G2R' WHEN rs >= 0 THEN 'GREEN' ELSE 'AMBER' END AS s_basket,
CASE phase WHEN 'down' THEN 'RED' WHEN 'turn' THEN 'R2G' WHEN 'up' THEN 'GREEN' ELSE 'G2R' END AS s_macd,
CASE WHEN fg IS NULL THEN 'AMBER' WHEN fg <= 10 THEN 'R2G' WHEN fg <= 25 AND fg_chg > 0 THEN 'R2G' WHEN fg <= 25 THEN 'RED' WHEN fg >= 75 AND fg_chg < 0 THEN 'G2R' WHEN fg >= 55 THEN 'GREEN' ELSE 'AMBER' END AS s_fg,
CASE WHEN vix >= 40 AND vix_chg <= 0 THEN 'R2G' WHEN vix >= 28 THEN 'RED' WHEN vix <= 17 THEN 'GREEN' WHEN NOT b AND vix_chg >= 4 THEN 'G2R' ELSE 'AMBER' END AS s_vix,
CASE WHEN b THEN 'R2G' WHEN ma <= 3 THEN 'AMBER' ELSE 'GREEN' END AS s_ma,
CASE WHEN streak >= 3 THEN CASE WHEN b THEN 'R2G' ELSE 'GREEN' END WHEN b AND streak = 0 THEN 'RED' ELSE 'AMBER' END AS s_eod,
CASE WHEN leaders >= 5 THEN CASE WHEN b THEN 'R2G' ELSE 'GREEN' END WHEN b AND leaders <= 2 THEN 'RED' ELSE 'AMBER' END AS s_lead,
CASE WHEN b AND btc_mom > 2 AND btc_up >= 2 THEN 'R2G' WHEN b THEN 'RED' WHEN btc_mom < -3 THEN 'G2R' WHEN btc_mom > 0 THEN 'GREEN' ELSE 'AMBER' END AS s_btc, fg IS NULL AS no_fg FROM mt),
sc AS (SELECT *, (""" + " + ".join(f"{w} * map {{'GREEN': 1.0, 'R2G': 0.5, 'AMBER': 0.0, 'G2R': -0.5, 'RED': -1.0}}[s_{k}]" + (" * (1 - CAST(no_fg AS INT))" if k == "fg" else "") for k, w in rules.WEIGHTS.items()) + """) / (7.5 + CASE WHEN no_fg THEN 0.0 ELSE 1.0 END) AS score FROM st),
tr AS (SELECT *, score - lag(score, 5) OVER (PARTITION BY series_id ORDER BY pos) AS trend FROM sc),
ov AS (SELECT series_id, date, pos, CASE WHEN score >= 0.45 THEN CASE WHEN trend < 0 THEN 'G2R' ELSE 'GREEN' END WHEN score <= -0.45 THEN CASE WHEN trend > 0 THEN 'R2G' ELSE 'RED' END WHEN trend > 0 THEN 'R2G' WHEN trend < 0 THEN 'G2R' ELSE 'AMBER' END AS d FROM tr),
rp AS (SELECT *, lag(d, 5) OVER (PARTITION BY series_id ORDER BY pos) AS w, lag(d, 21) OVER (PARTITION BY series_id ORDER BY pos) AS m FROM ov)"""
COMBO = """CASE WHEN m IN ('RED','G2R') AND w IN ('RED','G2R') AND d IN ('RED','G2R') THEN 1 WHEN d = 'R2G' AND w IN ('RED','G2R') AND m IN ('RED','G2R') THEN 2 WHEN w = 'R2G' AND d IN ('GREEN','R2G') AND m <> 'GREEN' THEN 3
WHEN m IN ('RED','AMBER','G2R') AND w IN ('GREEN','R2G') AND d = 'GREEN' THEN 4 WHEN m = 'R2G' AND (w IN ('RED','G2R') OR d IN ('RED','G2R')) THEN 5 WHEN m = 'R2G' THEN 6 WHEN m = 'GREEN' AND w NOT IN ('RED','G2R') AND d IN ('RED','R2G') THEN 7
WHEN m = 'GREEN' AND w = 'GREEN' AND d = 'G2R' THEN 8 WHEN m = 'GREEN' AND w IN ('RED','G2R') THEN 9 WHEN m = 'GREEN' AND w IN ('GREEN','AMBER') AND d IN ('GREEN','AMBER') THEN 10 ELSE 0 END"""
TONE = """CASE WHEN rule IN (1, 9) THEN 'reduce' WHEN rule IN (2, 5, 8) THEN 'caution' WHEN rule IN (3, 4, 6, 7) THEN 'buy' WHEN rule = 10 THEN 'hold' WHEN v[m] + v[w] + v[d] >= 1.05 THEN 'hold' WHEN v[m] + v[w] + v[d] <= -1.05 THEN 'reduce' ELSE 'neutral' END"""
VALUES = "map {'GREEN': 1.0, 'R2G': 0.5, 'AMBER': 0.0, 'G2R': -0.5, 'RED': -1.0} AS v"


@query(f"WITH {METRICS} SELECT series_id, CAST(date AS VARCHAR) AS date, pos, {', '.join('s_' + k for k in rules.WEIGHTS)}, {r6('score')} AS score FROM sc")
def rule_states(spark, sf):
    return rules.scored(_metrics(spark, sf))


def _replay(spark, sf):
    """Overall states of today, 5 and 21 sessions ago as daily, weekly and monthly states, with rule and tone."""
    d = rules.scored(_metrics(spark, sf))
    d = d.withColumn("trend", F.col("score") - F.lag("score", 5).over(expr.series())).withColumn("d", rules.overall(F.round("score", 12), F.round("trend", 12)))
    d = d.withColumns({"w": F.lag("d", 5).over(expr.series()), "m": F.lag("d", 21).over(expr.series())})
    return rules.with_tone(d.dropna(subset=["m", "w"]).select(SERIES, "date", "pos", "m", "w", "d"))


REPLAY = METRICS.replace("score - lag(score, 5) OVER (PARTITION BY series_id ORDER BY pos) AS trend FROM sc", "round(score - lag(score, 5) OVER (PARTITION BY series_id ORDER BY pos), 12) AS trend FROM (SELECT * REPLACE (round(score, 12) AS score) FROM sc)") + f", rl AS (SELECT *, {COMBO} AS rule, {VALUES} FROM rp WHERE m IS NOT NULL AND w IS NOT NULL), tn AS (SELECT *, {TONE} AS tone FROM rl)"


@query(f"WITH {REPLAY} SELECT series_id, CAST(date AS VARCHAR) AS date, pos, m, w, d, CAST(rule AS BIGINT) AS rule, tone FROM tn")
def replay(spark, sf):
    return _replay(spark, sf)


@query(f"WITH g AS (SELECT ['GREEN', 'R2G', 'AMBER', 'G2R', 'RED'][o_custkey % 5 + 1] AS m, ['GREEN', 'R2G', 'AMBER', 'G2R', 'RED'][o_orderkey % 5 + 1] AS w, ['GREEN', 'R2G', 'AMBER', 'G2R', 'RED'][(o_orderkey // 7) % 5 + 1] AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3), r AS (SELECT *, {COMBO} AS rule, {VALUES} FROM g) SELECT m, w, d, n, CAST(rule AS BIGINT) AS rule, {TONE} AS tone FROM r")
def combo_table(spark, sf):
    """Orders dealt to the 125 combinations by their keys: rule, tone and number of each."""
    state = lambda key: F.element_at(F.array(*map(F.lit, rules.STATES)), (F.col(key) % 5 + 1).cast("int"))
    o = market.table(spark, sf, "orders").select(state("o_custkey").alias("m"), state("o_orderkey").alias("w"), (F.floor(F.col("o_orderkey") / 7)).alias("k")).withColumn("d", state("k"))
    return rules.with_tone(o.groupBy("m", "w", "d").agg(F.count("*").alias("n")))


@query(f"WITH {REPLAY}, s AS (SELECT unnest(['GREEN', 'R2G', 'AMBER', 'G2R', 'RED']) AS s), g AS (SELECT a.s AS m, b.s AS w, c.s AS d FROM s a, s b, s c), r AS (SELECT *, {COMBO} AS rule, {VALUES} FROM g), n AS (SELECT m, w, d, count(*) AS n FROM tn GROUP BY 1, 2, 3) SELECT r.m, r.w, r.d, CAST(rule AS BIGINT) AS rule, {TONE.replace('v[m]', 'v[r.m]').replace('v[w]', 'v[r.w]').replace('v[d]', 'v[r.d]')} AS tone, coalesce(n, 0) AS n, {r6('coalesce(n, 0) / (SELECT count(*) FROM tn)')} AS share FROM r LEFT JOIN n ON r.m = n.m AND r.w = n.w AND r.d = n.d")
def cell_table_125(spark, sf):
    return rules.cell_table(_replay(spark, sf))


@query(f"WITH {REPLAY}, {FWD.format(src='bars')} SELECT tone, count(*) AS n, count(fwd_ret_20) AS realized, {r6('avg(CAST(fwd_ret_20 > 0 AS INT))')} AS hit, {r6('avg(fwd_ret_20)')} AS mean_ret, {r6('quantile_cont(fwd_ret_20, 0.1)')} AS p10, {r6('avg(CAST(fwd_maxdd_20 <= -0.05 AS INT))')} AS dd_rate FROM tn JOIN lab USING (series_id, pos) GROUP BY GROUPING SETS ((tone), ())")
def tone_scorecard(spark, sf):
    d = _replay(spark, sf).join(vol.targets(market.index_close(spark, sf)).drop("date"), [SERIES, "pos"])
    got = d.groupingSets([[F.col("tone")], []], "tone").agg(F.count("*").alias("n"), F.count("fwd_ret_20").alias("realized"), F.avg("y_sign_20").alias("hit"), F.avg("fwd_ret_20").alias("mean_ret"), F.percentile("fwd_ret_20", 0.1).alias("p10"), F.avg("y_dd5_20").alias("dd_rate"))
    return got


# ---- folds ------------------------------------------------------------------------------------------------------


def _ratios(spark, sf):
    oos = _oos(spark, sf)
    return oos.select(SERIES, "date", "pos", F.round(F.col("p") / F.nullif(F.col("clim"), F.lit(0.0)), 9).alias("r"))


@query(f"""WITH RECURSIVE {OOS}, rr AS (SELECT series_id, pos, round(p / nullif(clim, 0), 9) AS r, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM oos),
go AS (SELECT series_id, pos, r, i, CASE WHEN r >= 2.5 THEN 2 WHEN r >= 1.5 THEN 1 ELSE 0 END AS lv, 1 AS days, CASE WHEN r >= 1.5 THEN 1 ELSE 0 END AS ch FROM rr WHERE i = 1
UNION ALL SELECT n.series_id, n.pos, n.r, n.i, g2.lv, CASE WHEN g2.lv <> g2.old THEN 1 ELSE g2.days + 1 END, CASE WHEN g2.lv <> g2.old THEN 1 ELSE 0 END FROM (SELECT g.*, g.lv AS old FROM go g) g JOIN rr n ON n.series_id = g.series_id AND n.i = g.i + 1,
LATERAL (SELECT g.old, g.days, CASE WHEN n.r IS NULL THEN g.old WHEN (CASE WHEN n.r >= 2.5 THEN 2 WHEN n.r >= 1.5 THEN 1 ELSE 0 END) > g.old THEN (CASE WHEN n.r >= 2.5 THEN 2 ELSE 1 END) WHEN g.days >= 5 THEN least(g.old, CASE WHEN n.r >= 2.0 THEN 2 WHEN n.r >= 1.2 THEN 1 ELSE 0 END) ELSE g.old END AS lv) g2)
SELECT series_id, pos, ['normal', 'caution', 'reduce'][lv + 1] AS state, CAST(days AS BIGINT) AS days_in_state, CAST(ch AS BIGINT) AS changed, CAST(sum(ch) OVER (PARTITION BY series_id ORDER BY pos ROWS 251 PRECEDING) AS BIGINT) AS churn_252 FROM go""")
def decision_states(spark, sf):
    return folds.decisions(_ratios(spark, sf))


@query(f"""WITH {BARS}, rr AS (SELECT series_id, pos, r, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM bars WHERE r IS NOT NULL), sd AS (SELECT series_id, var_samp(r) AS v0 FROM rr WHERE i <= 60 GROUP BY 1),
ac AS (SELECT a.series_id, a.pos, a.i, sum(0.06 * pow(0.94, a.i - b.i) * b.r * b.r) AS s FROM rr a JOIN rr b ON a.series_id = b.series_id AND b.i > 60 AND b.i <= a.i AND a.i - b.i < 600 GROUP BY 1, 2, 3)
SELECT b.series_id, b.pos, {r6('CASE WHEN rr.i >= 60 THEN sqrt(252 * (pow(0.94, rr.i - 60) * v0 + coalesce(s, 0))) END')} AS sigma FROM bars b LEFT JOIN rr ON b.series_id = rr.series_id AND b.pos = rr.pos LEFT JOIN ac ON b.series_id = ac.series_id AND b.pos = ac.pos LEFT JOIN sd ON b.series_id = sd.series_id""")
def ewma_vol(spark, sf):
    return folds.ewma_vol(market.index_bars(spark, sf).withColumn("r", vol.log_return()))


def _targets_of_size(spark, sf):
    """Volatility targets, multipliers of the decision states and week ends."""
    d = folds.ewma_vol(market.index_bars(spark, sf).withColumn("r", vol.log_return()))
    s = folds.decisions(_ratios(spark, sf)).select(SERIES, "pos", F.when(F.col("state") == "reduce", 0.25).when(F.col("state") == "caution", 0.5).otherwise(1.0).alias("mult"))
    target = expr.clip(0.10 / F.col("sigma"), 0.25, 1.0)
    d = d.join(s, [SERIES, "pos"], "left").withColumn("w_target", expr.clip(target * F.col("mult"), 0.25, 1.0))
    return d.withColumn("week_end", F.col("pos") % 5 == 0)


def _decided(spark, sf):
    """Decided states with the label of each session and the ratio they were decided by."""
    oos = _oos(spark, sf)
    return folds.decisions(_ratios(spark, sf)).join(oos.select(SERIES, "pos", "date", "y", "p", "clim", "fwd_ret_20"), [SERIES, "pos"]).join(_ratios(spark, sf).select(SERIES, "pos", "r"), [SERIES, "pos"])


@query()
def sizing_path(spark, sf):
    return folds.sizing(_targets_of_size(spark, sf))


@query()
def sizing_variants(spark, sf):
    """Paths of several rules side by side: one fold keyed by variant and series."""
    d = _targets_of_size(spark, sf)
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(x).alias("scale")) for n, x in (("base", 1.0), ("low", 0.6), ("high", 1.5)))))
    d = d.select("*", grid.alias("v")).withColumn("w_target", expr.clip(F.col("w_target") * F.col("v.scale"), 0.25, 1.0)).withColumn("path", F.concat_ws("/", "v.variant", SERIES)).drop(SERIES)
    return folds.sizing(d, by="path")


@query()
def regime_probabilities(spark, sf):
    d = market.index_bars(spark, sf).withColumn("x", 100 * vol.log_return())
    return folds.regime_filter(d, folds.Regimes(0.98, 0.95, 0.05, -0.1, 0.6, 3.0))


@query(f"""WITH RECURSIVE {BARS}, gb AS (SELECT series_id, min(pos) AS pos FROM bars GROUP BY 1 UNION ALL SELECT g.series_id, g.pos + 20 FROM gb g WHERE EXISTS (SELECT 1 FROM bars b WHERE b.series_id = g.series_id AND b.pos = g.pos + 20))
SELECT b.series_id, b.pos, CAST(g.pos IS NOT NULL AS BIGINT) AS opens FROM bars b LEFT JOIN gb g USING (series_id, pos)""".replace("g.pos IS NOT NULL", "EXISTS (SELECT 1 FROM gb x WHERE x.series_id = b.series_id AND x.pos = b.pos)").replace(" LEFT JOIN gb g USING (series_id, pos)", ""))
def greedy_blocks(spark, sf):
    return folds.greedy_blocks(market.index_bars(spark, sf))


@query()
def macd_phases(spark, sf):
    return folds.macd_phase(market.index_close(spark, sf))


# ---- walk-forward fits ------------------------------------------------------------------------------------------


@query(f"WITH {BARS}, rf AS (SELECT series_id, year(date) AS year, min(pos) AS refit_pos, min(date) AS refit_date FROM bars GROUP BY 1, 2) SELECT series_id, year, refit_pos, CAST(refit_date AS VARCHAR) AS refit_date, coalesce(lead(refit_pos) OVER (PARTITION BY series_id ORDER BY year), -1) AS next_pos FROM rf")
def refit_schedule(spark, sf):
    return fit.refits(market.index_bars(spark, sf)).withColumn("next_pos", known("next_pos"))


@query(f"WITH {OOS}, rf AS (SELECT series_id, year(date) AS year, min(pos) AS rp FROM oos GROUP BY 1, 2) SELECT o.series_id, f.year, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r6('avg(y)')} AS clim FROM oos o JOIN rf f ON o.series_id = f.series_id AND o.pos <= rp - 21 GROUP BY 1, 2")
def training_mask_counts(spark, sf):
    return fit.training(_oos(spark, sf)).groupBy(SERIES, "year").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg("y").alias("clim"))


def _ladder(spark, sf):
    f = vol.targets(vol.har_components(market.index_bars(spark, sf), vol.garman_klass())).withColumnRenamed("y_dd5_20", "y")
    return f.withColumns({"x_har": vol.har_log_vol(), "x_ma": vol.sma_distance(), "ln_fwd": vol.har_target(F.col("r")), "l1": F.ln("rv1"), "l5": F.ln("rv5"), "l22": F.ln("rv22")})


@query()
def logit_walk_forward(spark, sf):
    return fit.logit_walk_forward(_ladder(spark, sf), ["x_har", "x_ma"]).select(SERIES, "year", "n", *(F.col("coef")[i].alias(f"b{i}") for i in range(3)))


@query()
def logit_scores(spark, sf):
    """Brier score and skill of the walk-forward probabilities against the climatology."""
    d = _ladder(spark, sf)
    scored = fit.score_segments(d, fit.logit_walk_forward(d, ["x_har", "x_ma"]), ["x_har", "x_ma"]).withColumn("clim", scoring.climatology()).dropna(subset=["pred", "y", "clim"])
    return scoring.block_scores(scored.withColumn("p", F.col("pred")).withColumn("block", F.year("date")))


HARFIT = VAR + """, hf AS (SELECT *, ln(rv1) AS l1, ln(rv5) AS l5, ln(rv22) AS l22, CASE WHEN count(r) OVER f = 20 AND stddev_samp(r) OVER f > 0 THEN ln(stddev_samp(r) OVER f * sqrt(252.0)) END AS z FROM har WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))"""


@query(f"WITH {HARFIT}, rf AS (SELECT series_id, year(date) AS year, min(pos) AS rp FROM hf GROUP BY 1, 2), g AS (SELECT h.series_id, f.year, count(*) AS n, regr_slope(z, l22) AS b1, regr_intercept(z, l22) AS b0 FROM hf h JOIN rf f ON h.series_id = f.series_id AND h.pos <= rp - 21 WHERE z IS NOT NULL AND l22 IS NOT NULL GROUP BY 1, 2) SELECT series_id, year, n, {r6('b0')} AS b0, {r6('b1')} AS b1 FROM g WHERE n >= 100")
def ols_walk_forward(spark, sf):
    """Forward volatility on its 22-day past by refit; with one regressor, SQL has the same least squares."""
    return fit.ols_walk_forward(_ladder(spark, sf), ["l22"], "ln_fwd").select(SERIES, "year", "n", F.col("coef")[0].alias("b0"), F.col("coef")[1].alias("b1"))


@query()
def har_walk_forward(spark, sf):
    d = _ladder(spark, sf)
    got = fit.score_segments(d, fit.ols_walk_forward(d, ["l1", "l5", "l22"], "ln_fwd"), ["l1", "l5", "l22"], linear=True)
    return got.dropna(subset=["pred", "ln_fwd"]).groupBy(SERIES).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("pred") - F.col("ln_fwd"), 2)).alias("log_mse"), F.corr("pred", "ln_fwd").alias("corr"))


def uniform_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def bootstrap_sql(name: str, source: str, by: str, values: str, draws: int, statistic: str, block: int = 40, order: str = "pos", seed: int = 0) -> str:
    """CTE ``name`` (by, n, estimate, low, high): every draw's rows are listed block by block. values: 'a, b'; statistic of sums {0}, {1}."""
    v = values.split(", ")
    means = statistic.format(*(f"avg({x})" for x in v))
    drawn = statistic.format(*(f"sum({x}) / any_value(n)" for x in v))
    return f"""{name}_r AS (SELECT {by}, {values}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
{name}_p AS (SELECT *, {', '.join(f"sum({x}) OVER (PARTITION BY {by} ORDER BY k ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS f_{x}, list({x}) OVER (PARTITION BY {by} ORDER BY k ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS l_{x}, list({x}) OVER (PARTITION BY {by}, k < {block} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h_{x}" for x in v)} FROM {name}_r),
{name}_h AS (SELECT {by}, {', '.join(f"any_value(h_{x}) AS h_{x}" for x in v)} FROM {name}_p WHERE k < {block} GROUP BY {by}),
{name}_g AS (SELECT {by}, any_value(n) AS n, CAST(ceil(any_value(n) / {float(block)}) AS BIGINT) AS b FROM {name}_r GROUP BY {by}),
{name}_d AS (SELECT {by}, n, b, draw, i, CAST(floor({uniform_sql(str(seed), 'draw', 'i')} * n) AS BIGINT) AS k, CASE WHEN i = b - 1 THEN n - (b - 1) * {block} ELSE {block} END AS size FROM (SELECT *, unnest(range(0, b)) AS i FROM (SELECT *, unnest(range(0, {draws})) AS draw FROM {name}_g))),
{name}_s AS (SELECT {by}, draw, any_value(d.n) AS n, {', '.join(f"sum(CASE WHEN size = {block} AND len(l_{x}) = {block} THEN f_{x} ELSE list_sum(list_concat(l_{x}, h_{x}, h_{x}, h_{x})[:size]) END) AS {x}" for x in v)} FROM {name}_d d JOIN (SELECT * EXCLUDE (n, {', '.join(f'h_{x}' for x in v)}) FROM {name}_p) p USING ({by}, k) JOIN {name}_h USING ({by}) GROUP BY {by}, draw),
{name}_x AS (SELECT {by}, {statistic.format(*(f"({x} / n)" for x in v))} AS x FROM {name}_s),
{name} AS (SELECT * FROM (SELECT {by}, count(*) AS n, {means} AS estimate FROM {name}_r GROUP BY {by}) JOIN (SELECT {by}, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM {name}_x GROUP BY {by}) USING ({by}))"""


@query(f"WITH {OOS}, ls AS (SELECT series_id, pos, pow(p - y, 2) AS lp, pow(clim - y, 2) AS lc FROM oos), {bootstrap_sql('bo', 'ls', 'series_id', 'lp, lc', 4000, '1 - {0} / {1}')} SELECT series_id, n, {r6('estimate')} AS estimate, {r6('low')} AS low, {r6('high')} AS high FROM bo")
def bootstrap_skill(spark, sf):
    d = _oos(spark, sf).withColumns({"lp": scoring.loss("p"), "lc": scoring.loss("clim")})
    return bootstrap.interval(d, "lp", [SERIES], draws=4000, ratio_to="lc")


@query()
def regime_refits(spark, sf):
    return fit.regimes(vol.regime_observations(market.index_bars(spark, sf)))


# ---- ledger and control -----------------------------------------------------------------------------------------


def _ledger(spark, sf):
    """A ledger of the replay's rows: variant completed on even sessions, faithful on odd ones."""
    return _replay(spark, sf).select(SERIES, F.col("date").alias("asof"), F.when(F.col("pos") % 2 == 0, "completed").otherwise("faithful").alias("variant"), "tone", "pos")


LEDGER = REPLAY + ", " + FWD.format(src="bars") + ", lg AS (SELECT t.series_id, t.date AS \"asof\", CASE WHEN t.pos % 2 = 0 THEN 'completed' ELSE 'faithful' END AS variant, tone, t.pos, round(fwd_ret_20, 6) AS fwd_ret_20, round(fwd_ret_60, 6) AS fwd_ret_60, CASE WHEN c20 IS NOT NULL THEN CAST(round(m20 / close - 1, 6) <= -0.05 AS INT) END AS y_dd5_20 FROM tn t JOIN (SELECT * EXCLUDE (date) FROM lab) USING (series_id, pos))"


@query(f"WITH {LEDGER} SELECT series_id, CAST(\"asof\" AS VARCHAR) AS \"asof\", variant, tone, pos, {r6('fwd_ret_20')} AS fwd_ret_20, {r6('fwd_ret_60')} AS fwd_ret_60, coalesce(CAST(y_dd5_20 AS BIGINT), -1) AS y_dd5_20 FROM lg")
def ledger_backfill(spark, sf):
    return store.backfill(_ledger(spark, sf), market.index_close(spark, sf)).withColumn("y_dd5_20", known("y_dd5_20"))


@query(f"WITH {LEDGER} SELECT variant, tone, count(*) AS n, count(fwd_ret_20) AS realized, {r6('avg(CAST(fwd_ret_20 > 0 AS INT))')} AS hit_20, {r6('avg(fwd_ret_20)')} AS mean_20, {r6('avg(y_dd5_20)')} AS dd_rate FROM lg GROUP BY GROUPING SETS ((variant, tone), (variant), (tone))")
def ledger_summary_sets(spark, sf):
    return store.summary(store.backfill(_ledger(spark, sf), market.index_close(spark, sf)))


@query(f"WITH {REPLAY}, lg AS (SELECT series_id, date FROM tn WHERE pos % 10 <> 3), sp AS (SELECT series_id, min(date) AS a, max(date) AS b FROM lg GROUP BY 1) SELECT p.series_id, CAST(p.date AS VARCHAR) AS date FROM (SELECT DISTINCT date FROM px) q CROSS JOIN sp p0 JOIN (SELECT s.series_id, d.date FROM sp s, (SELECT DISTINCT date FROM px) d WHERE d.date BETWEEN s.a AND s.b) p ON p.series_id = p0.series_id AND p.date = q.date WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.series_id = p.series_id AND lg.date = p.date)")
def missing_sessions(spark, sf):
    return store.missing_sessions(_ledger(spark, sf).filter("pos % 10 <> 3"), market.index_close(spark, sf).select("date").distinct())


@query(f"""WITH {REPLAY} SELECT series_id, CAST(date AS VARCHAR) AS "asof", CASE WHEN pos % 2 = 0 THEN 'completed' ELSE 'faithful' END AS variant, tone, pos FROM tn""")
def ledger_append(spark, sf):
    """Appending the last rows again adds only those that are missing."""
    rows = _ledger(spark, sf)
    return store.append(rows.filter("pos % 3 <> 0"), rows, (SERIES, "asof", "variant"))


def _live(spark, sf):
    oos = _oos(spark, sf)
    return oos.select(SERIES, "date", "pos", "p", "y", "clim", (F.ln("rv22") - F.ln(F.lit(0.17))).alias("ln_err"), F.when(F.col("p") > 0.3, 0.2).otherwise(0.5).alias("w"), (F.col("pos") % 9 == 0).alias("changed"))


@query(f"""WITH {OOS}, li AS (SELECT series_id, pos, p, y, clim, abs(ln(rv22) - ln(0.17)) AS e, CASE WHEN p > 0.3 THEN 0.2 ELSE 0.5 END AS w, CASE WHEN pos % 9 = 0 THEN 1 ELSE 0 END AS ch FROM oos),
q AS (SELECT series_id, pos, {', '.join(f"CASE WHEN count(*) OVER w{k} = {k} THEN {x} END AS {n}" for n, k, x in (('d1', 120, 'avg(p) OVER w120'), ('d2r', 756, '1 - avg(pow(p - y, 2)) OVER w756 / nullif(avg(pow(clim - y, 2)) OVER w756, 0)'), ('d2y', 252, '1 - avg(pow(p - y, 2)) OVER w252 / nullif(avg(pow(clim - y, 2)) OVER w252, 0)'), ('d3', 60, 'avg(e) OVER w60'), ('d5', 252, 'avg(w) OVER w252'), ('d6', 252, 'sum(ch) OVER w252')))} FROM li
WINDOW {', '.join(f'w{k} AS (PARTITION BY series_id ORDER BY pos ROWS {k - 1} PRECEDING)' for k in (60, 120, 252, 756))}),
u AS (SELECT series_id, pos, 'D1' AS code, round(d1, 6) AS value FROM q WHERE NOT round(d1, 6) BETWEEN 0.04 AND 0.35 UNION ALL SELECT series_id, pos, 'D2_red', round(d2r, 6) FROM q WHERE round(d2r, 6) < -0.05 UNION ALL SELECT series_id, pos, 'D2_yellow', round(d2y, 6) FROM q WHERE round(d2y, 6) < -0.10
UNION ALL SELECT series_id, pos, 'D3', round(d3, 6) FROM q WHERE round(d3, 6) > 0.5 UNION ALL SELECT series_id, pos, 'D5', round(d5, 6) FROM q WHERE round(d5, 6) < 0.3 UNION ALL SELECT series_id, pos, 'D6', CAST(d6 AS DOUBLE) FROM q WHERE d6 > 24)
SELECT series_id, pos, code, value FROM u""")
def drift_alarms(spark, sf):
    return store.alarms(_live(spark, sf))


@query(f"""WITH {OOS}{EPS_BODY.replace('FROM bars', 'FROM (SELECT series_id, date, pos, close FROM bars)')}, g AS (SELECT series_id, min(pos) AS fp, (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) AS months, 1 - avg(pow(p - y, 2)) / nullif(avg(pow(clim - y, 2)), 0) AS skill FROM oos GROUP BY 1),
k AS (SELECT g.*, (SELECT count(*) FROM ep WHERE ep.series_id = g.series_id AND ep.breach_pos >= g.fp) AS episodes FROM g), s AS (SELECT *, CASE WHEN months < 36 THEN 'waiting' WHEN episodes >= 8 OR months >= 60 THEN 'evaluate' ELSE 'extended' END AS stage FROM k)
SELECT series_id, months, episodes, {r6('skill')} AS skill, stage, CASE WHEN stage <> 'evaluate' THEN 'continue' WHEN skill <= 0 THEN 'kill' ELSE 'pass' END AS verdict FROM s""")
def kill_rule(spark, sf):
    return store.kill_status(_oos(spark, sf), paths.episodes(market.index_close(spark, sf), 0.05))


@query(f"WITH {OOS} SELECT 'p' AS \"column\", count(*) AS n, count(*) FILTER (pos % 50 = 0) AS differ, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b FROM oos UNION ALL SELECT 'clim', count(*), 0, count(*) FILTER (pos % 70 = 0), 0 FROM oos")
def replay_check(spark, sf):
    """A recomputation with planted differences: each is found."""
    d = _oos(spark, sf).select(SERIES, "pos", "p", "clim")
    other = d.withColumns({"p": F.when(F.col("pos") % 50 == 0, F.col("p") + 1e-3).otherwise(F.col("p")), "clim": F.when(F.col("pos") % 70 != 0, F.col("clim"))})
    return store.replay_check(d, other, ["p", "clim"])


# ---- expressions ------------------------------------------------------------------------------------------------


@query(f"WITH v AS (SELECT value / 100.0 AS x FROM events) SELECT {r6('x')} AS x, count(*) AS n, {r6('max(' + phi_sql('x - 1') + ')')} AS phi FROM v GROUP BY x")
def normal_distribution(spark, sf):
    v = market.table(spark, sf, "events").select((F.col("value") / 100.0).alias("x"))
    return v.groupBy("x").agg(F.count("*").alias("n"), F.max(expr.phi(F.col("x") - 1)).alias("phi")).select("x", "n", "phi")


@query(f"WITH g AS (SELECT o_orderpriority AS k, avg(CAST(o_orderstatus = 'F' AS INT)) AS p, count(*) / 20.0 AS n FROM orders GROUP BY 1) SELECT k, {r6('p')} AS p, {r6('n')} AS n_eff, {r6(WILSON[0].format(p='p', n='n'))} AS low, {r6(WILSON[1].format(p='p', n='n'))} AS high FROM g")
def wilson_table(spark, sf):
    g = market.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p"), (F.count("*") / 20).alias("n_eff"))
    low, high = expr.wilson(F.col("p"), F.col("n_eff"))
    return g.select("k", "p", "n_eff", low.alias("low"), high.alias("high"))


@query("SELECT CAST(l.quality AS BIGINT) AS y, count(*) AS n FROM labels l GROUP BY 1")
def label_counts(spark, sf):
    return market.table(spark, sf, "labels").groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n"))
