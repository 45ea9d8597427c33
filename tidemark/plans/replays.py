"""Queries of the replays: the rule engine on three frames, and what follows from it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.expr import SERIES
from tidemark.operators import kill_replay as kills
from tidemark.operators import evaluation, paths, reference, rules, sessions, timeframes, vol
from tidemark.plans.queries import COMBO, EPS_BODY, FWD, OOS, ORD, PX, QUERIES, TONE, VALUES, _oos, bootstrap_sql, query, r6, uniform_sql
from tidemark.plans.research import AROUND, DECIDED
from tidemark.sources import market

# ---- the rule engine on daily, weekly and monthly bars ----------------------------------------------------------

PARTS, TICKERS = 3, 7


def _days(spark, sf):
    """Sessions of the index with the second index as coin, three parts as basket, seven parts as watch list."""
    close = market.index_close(spark, sf)
    d = vol.ffill(close, market.pseudo_vix(spark, sf), "vix").select(SERIES, "date", "pos", "close", "vix")
    coin = market.other_close(spark, sf).select(SERIES, "date", F.col("close").alias("btc"))
    parts = market.part_close(spark, sf, "l_suppkey", PARTS).groupBy(SERIES, "date").pivot("ticker", list(range(PARTS))).agg(F.max("close"))
    parts = parts.select(SERIES, "date", *(F.col(str(i)).alias(f"part{i}") for i in range(PARTS)))
    d = d.join(coin, [SERIES, "date"], "left").join(parts, [SERIES, "date"], "left")
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(expr.whole()) for c in ("btc", *(f"part{i}" for i in range(PARTS)))})
    watch = market.part_close(spark, sf, "l_partkey", TICKERS).join(close.select(SERIES, "date", "pos"), [SERIES, "date"]).select(SERIES, "ticker", "pos", "close")
    lead = timeframes.leaders(watch, close)
    fg = F.when(F.col("pos") % 7 != 0, (F.col("pos") * 13 % 101).cast("double"))
    eod = F.when(F.col("pos") % 11 != 0, F.col("close") / F.lag("close").over(expr.series()) - 1 > 0.001)
    d = d.withColumns({"fg": fg, "eod": eod}).join(lead, [SERIES, "pos"], "left")
    return timeframes.with_period_ends(d, sessions.sessions(spark, 1994, 2003))


def _part_sql(key: str, n: int) -> str:
    return f"""SELECT series_id, ticker, date, 100 * exp(sum(r) OVER (PARTITION BY series_id, ticker ORDER BY date)) AS close FROM (SELECT *, 0.011 * (a - avg(a) OVER p) / stddev_samp(a) OVER p + 0.0002 AS r FROM (
SELECT 'S' || (l_suppkey % 4) AS series_id, {key} // 4 % {n} AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1, 2, 3) WINDOW p AS (PARTITION BY series_id, ticker))"""


_FRAMES = ", ".join(f"('{tf}', {timeframes.LOOKBACK[tf]}, {timeframes.MOMENTUM[tf]}, {timeframes.CONFIRM[tf]}, {k})" for tf in timeframes.CUTS for k in (0, timeframes.CUTS[tf]))
_BACK = "".join(f"WHEN frame = '{tf}' THEN {k} " for tf, k in timeframes.FG_BEFORE.items())
_FAST, _SLOW, _SIGNAL = (2 / (k + 1) for k in (timeframes.FAST, timeframes.SLOW, timeframes.SIGNAL))
_UNTIL = "ORDER BY pos ROWS UNBOUNDED PRECEDING"
#: Every session's bars are rebuilt from its window: the sessions that end a bar before its own, and itself.
FRAMES = f"""{AROUND}, {PX}, {ORD},
bp AS ({_part_sql('l_suppkey', PARTS)}), wp AS ({_part_sql('l_partkey', TICKERS)}),
dy AS (SELECT p.series_id, p.date, p.pos, p.close, last_value(v.vix IGNORE NULLS) OVER (PARTITION BY p.series_id ORDER BY p.pos ROWS 3 PRECEDING) AS vix, last_value(o.close IGNORE NULLS) OVER w AS btc, {", ".join(f"last_value(b{i}.close IGNORE NULLS) OVER w AS part{i}" for i in range(PARTS))},
  CASE WHEN p.pos % 7 <> 0 THEN p.pos * 13 % 101 END AS fg, CASE WHEN p.pos % 11 <> 0 THEN p.close / lag(p.close) OVER (PARTITION BY p.series_id ORDER BY p.pos) - 1 > 0.001 END AS eod,
  date_trunc('week', p.date + 2)::DATE + 4 AS week, last_day(p.date) AS month, p.date IN (SELECT date FROM tr) AS op, (SELECT min(date) FROM tr WHERE tr.date > p.date) AS nx
  FROM px p LEFT JOIN vx v USING (series_id, date) LEFT JOIN ox o USING (series_id, date) {" ".join(f"LEFT JOIN bp b{i} ON b{i}.series_id = p.series_id AND b{i}.date = p.date AND b{i}.ticker = {i}" for i in range(PARTS))} WINDOW w AS (PARTITION BY p.series_id ORDER BY p.pos ROWS UNBOUNDED PRECEDING)),
d1 AS (SELECT *, date = week OR (op AND nx > week) AS week_done, date = month OR (op AND nx > month) AS month_done, week <> coalesce(lead(week) OVER s, week) AS week_last, month <> coalesce(lead(month) OVER s, month) AS month_last,
  CASE WHEN count(*) OVER s180 = 180 THEN avg(close) OVER s180 END AS sma, sum(CASE WHEN NOT eod THEN 1 ELSE 0 END) OVER s AS eb, btc > lag(btc) OVER s AS bu FROM dy WINDOW s AS (PARTITION BY series_id ORDER BY pos), s180 AS (PARTITION BY series_id ORDER BY pos ROWS 179 PRECEDING)),
d2 AS (SELECT *, sum(CASE WHEN NOT bu THEN 1 ELSE 0 END) OVER (PARTITION BY series_id {_UNTIL}) AS bb, sum(CASE WHEN eod THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, eb {_UNTIL}) AS eod_run FROM d1),
wl AS (SELECT w.*, p.pos, row_number() OVER t AS n, w.close / max(w.close) OVER (PARTITION BY w.series_id, w.ticker ORDER BY p.pos ROWS 59 PRECEDING) - 1 AS dd, (w.close / lag(w.close, 5) OVER t - 1) * 100 AS r5, (w.close / lag(w.close, 20) OVER t - 1) * 100 AS r20
  FROM wp w JOIN px p USING (series_id, date) WINDOW t AS (PARTITION BY w.series_id, w.ticker ORDER BY p.pos)),
ix AS (SELECT series_id, pos, CASE WHEN count(*) OVER c = 60 THEN close / max(close) OVER c - 1 END AS idd, coalesce((close / lag(close, 20) OVER (PARTITION BY series_id ORDER BY pos) - 1) * 100, 0) AS ir FROM px WINDOW c AS (PARTITION BY series_id ORDER BY pos ROWS 59 PRECEDING)),
le AS (SELECT series_id, pos, count(*) AS watched, count(*) FILTER (WHERE dd >= 0.6 * idd AND r5 > 0) AS lead_below, count(*) FILTER (WHERE r20 - ir > 3) AS lead_above FROM wl JOIN ix USING (series_id, pos) WHERE n >= {timeframes.LEAST_BARS} GROUP BY 1, 2),
d3 AS (SELECT d2.*, coalesce(watched, 0) AS watched, coalesce(lead_below, 0) AS lead_below, coalesce(lead_above, 0) AS lead_above, sum(CASE WHEN bu THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, bb {_UNTIL}) AS btc_run FROM d2 LEFT JOIN le USING (series_id, pos)),
fr(frame, lb, mk, confirm, cut) AS (VALUES {_FRAMES}),
vw AS (SELECT t.series_id, t.pos, fr.*, va.variant, u.pos AS upos, (t.date - INTERVAL {timeframes.MONTHS} MONTH)::DATE AS start, CASE frame WHEN 'daily' THEN u.date WHEN 'weekly' THEN u.week ELSE u.month END AS label, variant = 'faithful' OR frame = 'daily' OR (frame = 'weekly' AND u.week_done) OR (frame = 'monthly' AND u.month_done) AS with_open
  FROM d3 t CROSS JOIN fr CROSS JOIN (VALUES ('faithful'), ('completed')) va(variant) JOIN d3 u ON u.series_id = t.series_id AND u.pos = t.pos - cut WHERE frame <> 'daily' OR variant = 'faithful'),
br AS (SELECT v.series_id, v.pos, frame, cut, variant, any_value(lb) AS lb, any_value(mk) AS mk, any_value(confirm) AS confirm, any_value(upos) AS upos, list({{'c': b.close, 'v': b.vix, 'b': b.btc, 'p': [{", ".join(f"b.part{i}" for i in range(PARTS))}]}} ORDER BY b.pos) AS bars
  FROM vw v JOIN d3 b ON b.series_id = v.series_id AND b.date > v.start AND (b.pos < v.upos AND (frame = 'daily' OR (frame = 'weekly' AND b.week_last) OR (frame = 'monthly' AND b.month_last)) OR b.pos = v.upos AND with_open) GROUP BY 1, 2, 3, 4, 5),
em AS (SELECT *, list_reduce(list_prepend({{'f': bars[1].c, 's': bars[1].c, 'g': 0.0::DOUBLE, 'h': [0.0::DOUBLE], 'x': 0.0::DOUBLE}}, list_transform(bars[2:], lambda b: {{'f': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'h': []::DOUBLE[], 'x': b.c}})),
  lambda a, z: list_transform([{{'f': (1 - {_FAST}) * a.f + {_FAST} * z.x, 's': (1 - {_SLOW}) * a.s + {_SLOW} * z.x}}], lambda n: {{'f': n.f, 's': n.s, 'g': (1 - {_SIGNAL}) * a.g + {_SIGNAL} * (n.f - n.s), 'h': list_append(a.h[greatest(1, len(a.h) - 30):], n.f - n.s - ((1 - {_SIGNAL}) * a.g + {_SIGNAL} * (n.f - n.s))), 'x': z.x}})[1]).h AS h, len(bars) AS n FROM br),
mv AS (SELECT * EXCLUDE (h), CASE WHEN abs(h[-1]) > {timeframes.STILL} * c.close THEN h[-1] ELSE 0 END AS h0, list_transform(range(1, len(h)), lambda i: CASE WHEN abs(h[-i] - h[-i - 1]) <= {timeframes.STILL} * c.close THEN 0 WHEN h[-i] > h[-i - 1] THEN 1 ELSE -1 END) AS m FROM em JOIN (SELECT series_id, pos, close FROM d3) c USING (series_id, pos)),
ru AS (SELECT *, coalesce(list_position(list_transform(m, lambda x: x <> 1), true) - 1, len(m), 0) AS up, coalesce(list_position(list_transform(m, lambda x: x <> -1), true) - 1, len(m), 0) AS dn FROM mv),
ph AS (SELECT *, CASE WHEN h0 < 0 AND up >= confirm THEN 'turn' WHEN h0 > 0 AND dn >= confirm THEN 'roll' WHEN h0 >= 0 THEN 'up' ELSE 'down' END AS phase FROM ru),
me AS (SELECT r.series_id, r.pos, r.frame, r.cut, r.variant, r.phase, CASE WHEN phase IN ('turn', 'up') THEN up ELSE dn END AS run, s.p AS p0, r.bars[-1] AS e, CASE WHEN n > lb THEN r.bars[n - lb] END AS l, CASE WHEN n > mk THEN (r.bars[-1].b / r.bars[n - mk].b - 1) * 100 ELSE 0 END AS btc_mom, upos FROM ph r
  JOIN (SELECT t.series_id, t.pos, first([{", ".join(f"b.part{i}" for i in range(PARTS))}] ORDER BY b.pos) AS p FROM d3 t JOIN d3 b ON b.series_id = t.series_id AND b.pos <= t.pos AND b.date > (t.date - INTERVAL {timeframes.MONTHS} MONTH)::DATE GROUP BY 1, 2) s USING (series_id, pos)),
mf AS (SELECT * EXCLUDE (e, l, p0), CASE WHEN l IS NULL THEN CASE WHEN list_count(p0) = {PARTS} THEN 0.0 END ELSE ((({" + ".join(f"e.p[{i}] / p0[{i}]" for i in range(1, PARTS + 1))}) / {PARTS}) / (({" + ".join(f"l.p[{i}] / p0[{i}]" for i in range(1, PARTS + 1))}) / {PARTS}) - 1) * 100 - (e.c / l.c - 1) * 100 END AS rs, e.v AS vix, CASE WHEN l IS NULL THEN e.v - e.v ELSE e.v - l.v END AS vix_chg FROM me),
mx AS (SELECT m.*, t.date, t.fg, t.eod IS NULL AS no_eod, t.watched = 0 AS no_lead, (u.close / u.sma - 1) * 100 AS ma, least(u.eod_run, 30 - cut) AS streak, u.lead_below, u.lead_above, u.btc_run AS btc_up,
  coalesce(round_even(t.fg - (SELECT last(q.fg ORDER BY q.pos) FROM d3 q WHERE q.series_id = m.series_id AND q.pos <= m.pos - CASE {_BACK}END AND q.pos >= m.pos - CASE {_BACK}END - 6 AND q.fg IS NOT NULL), 0), 0) AS fg_chg FROM mf m JOIN d3 t ON t.series_id = m.series_id AND t.pos = m.pos JOIN d3 u ON u.series_id = m.series_id AND u.pos = m.upos),
my AS (SELECT * EXCLUDE (variant), CASE WHEN ma <= 0 THEN lead_below ELSE lead_above END AS leaders, ma <= 0 AS b, unnest(CASE WHEN frame = 'daily' THEN ['faithful', 'completed'] ELSE [variant] END) AS variant FROM mx WHERE ma IS NOT NULL AND rs IS NOT NULL AND vix IS NOT NULL AND vix_chg IS NOT NULL AND btc_mom IS NOT NULL)"""


@query(f"WITH {FRAMES} SELECT series_id, pos, CAST(date AS VARCHAR) AS date, frame, variant, cut, {r6('ma')} AS ma, {r6('rs')} AS rs, phase, CAST(run AS BIGINT) AS run, coalesce(CAST(fg AS BIGINT), -1) AS fg, {r6('CAST(fg_chg AS DOUBLE)')} AS fg_chg, {r6('vix')} AS vix, {r6('vix_chg')} AS vix_chg, CAST(streak AS BIGINT) AS streak, CAST(leaders AS BIGINT) AS leaders, {r6('btc_mom')} AS btc_mom, CAST(btc_up AS BIGINT) AS btc_up FROM my")
def timeframe_metrics(spark, sf):
    """The engine's metrics on each frame and variant, now and rewound."""
    got = timeframes.metrics(_days(spark, sf), [f"part{i}" for i in range(PARTS)])
    return got.drop("no_eod", "no_lead").withColumn("fg", F.coalesce(F.col("fg").cast("long"), F.lit(-1)))


_STATE = {
    "basket": "CASE WHEN b AND rs >= 1.5 THEN 'R2G' WHEN b AND rs <= -1.5 THEN 'RED' WHEN b THEN 'AMBER' WHEN rs <= -2 THEN 'G2R' WHEN rs >= 0 THEN 'GREEN' ELSE 'AMBER' END",
    "macd": "CASE phase WHEN 'down' THEN 'RED' WHEN 'turn' THEN 'R2G' WHEN 'up' THEN 'GREEN' ELSE 'G2R' END",
    "fg": "CASE WHEN fg IS NULL THEN 'AMBER' WHEN fg <= 10 THEN 'R2G' WHEN fg <= 25 AND fg_chg > 0 THEN 'R2G' WHEN fg <= 25 THEN 'RED' WHEN fg >= 75 AND fg_chg < 0 THEN 'G2R' WHEN fg >= 55 THEN 'GREEN' ELSE 'AMBER' END",
    "vix": "CASE WHEN vix >= 40 AND vix_chg <= 0 THEN 'R2G' WHEN vix >= 28 THEN 'RED' WHEN vix <= 17 THEN 'GREEN' WHEN NOT b AND vix_chg >= 4 THEN 'G2R' ELSE 'AMBER' END",
    "ma": "CASE WHEN b THEN 'R2G' WHEN ma <= 3 THEN 'AMBER' ELSE 'GREEN' END",
    "eod": "CASE WHEN streak >= 3 THEN CASE WHEN b THEN 'R2G' ELSE 'GREEN' END WHEN b AND streak = 0 THEN 'RED' ELSE 'AMBER' END",
    "lead": "CASE WHEN leaders >= 5 THEN CASE WHEN b THEN 'R2G' ELSE 'GREEN' END WHEN b AND leaders <= 2 THEN 'RED' ELSE 'AMBER' END",
    "btc": "CASE WHEN b AND btc_mom > 2 AND btc_up >= 2 THEN 'R2G' WHEN b THEN 'RED' WHEN btc_mom < -3 THEN 'G2R' WHEN btc_mom > 0 THEN 'GREEN' ELSE 'AMBER' END",
}
_GONE = {"fg": "frame <> 'daily' OR fg IS NULL", "ma": "frame <> 'daily'", "eod": "frame <> 'daily' OR no_eod", "lead": "frame <> 'daily' OR no_lead"}
_THERE = {k: f"CASE WHEN {_GONE.get(k, 'false')} THEN 0::DOUBLE ELSE 1::DOUBLE END" for k in rules.WEIGHTS}
_SC = "map {'GREEN': 1.0::DOUBLE, 'R2G': 0.5::DOUBLE, 'AMBER': 0.0::DOUBLE, 'G2R': -0.5::DOUBLE, 'RED': -1.0::DOUBLE}"
FRAME_REPLAY = f"""{FRAMES},
sf AS (SELECT series_id, pos, date, frame, variant, cut, ({" + ".join(f"{w}::DOUBLE * {_SC}[{_STATE[k]}] * {_THERE[k]}" for k, w in rules.WEIGHTS.items())}) / ({" + ".join(f"{w}::DOUBLE * {_THERE[k]}" for k, w in rules.WEIGHTS.items())}) AS score FROM my),
sw AS (SELECT series_id, pos, date, variant, {", ".join(f"max(score) FILTER (WHERE frame = '{tf}' AND cut {op} 0) AS {tf[0]}_{n}" for tf in timeframes.CUTS for op, n in (("=", "now"), (">", "then")))} FROM sf GROUP BY ALL),
so AS (SELECT *, {", ".join(f"CASE WHEN {f}_now - {f}_then > {timeframes.TREND}::DOUBLE THEN 1 WHEN {f}_now - {f}_then < -{timeframes.TREND}::DOUBLE THEN -1 ELSE 0 END AS trend_{f}" for f in "dwm")} FROM sw WHERE {" AND ".join(f"{f}_{n} IS NOT NULL" for f in "dwm" for n in ("now", "then"))}),
ss AS (SELECT *, {", ".join(f"CASE WHEN {f}_now >= 0.45::DOUBLE THEN CASE WHEN trend_{f} < 0 THEN 'G2R' ELSE 'GREEN' END WHEN {f}_now <= -0.45::DOUBLE THEN CASE WHEN trend_{f} > 0 THEN 'R2G' ELSE 'RED' END WHEN trend_{f} > 0 THEN 'R2G' WHEN trend_{f} < 0 THEN 'G2R' ELSE 'AMBER' END AS {f}" for f in "dwm")} FROM so),
sr AS (SELECT *, {COMBO} AS rule, {VALUES} FROM ss), tf AS (SELECT *, {TONE} AS tone FROM sr)"""


@query(f"WITH {FRAME_REPLAY} SELECT series_id, pos, CAST(date AS VARCHAR) AS date, variant, {', '.join(f'{r6(f + chr(95) + chr(110) + chr(111) + chr(119))} AS score_{f}, CAST(trend_{f} AS BIGINT) AS trend_{f}' for f in 'dwm')}, m, w, d, CAST(rule AS BIGINT) AS rule, tone FROM tf")
def timeframe_replay(spark, sf):
    """Overall states of the three frames on their own bars, both variants, with the rule and the tone."""
    return timeframes.replay(timeframes.metrics(_days(spark, sf), [f"part{i}" for i in range(PARTS)]))


@query(f"WITH {FRAME_REPLAY} SELECT series_id, a.tone AS faithful, b.tone AS completed, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY series_id)')} AS share FROM tf a JOIN tf b USING (series_id, pos) WHERE a.variant = 'faithful' AND b.variant = 'completed' GROUP BY 1, 2, 3")
def variant_agreement(spark, sf):
    """How often bars that are still open change the tone."""
    d = timeframes.replay(timeframes.metrics(_days(spark, sf), [f"part{i}" for i in range(PARTS)]))
    both = d.groupBy(SERIES, "pos").agg(*(F.max(F.when(F.col("variant") == v, F.col("tone"))).alias(v) for v in ("faithful", "completed"))).dropna()
    n = both.groupBy(SERIES, "faithful", "completed").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(SERIES)))


# ---- the kill rule at every 21st session ------------------------------------------------------------------------


def _skill_sql(name: str, losses: str, extra: str = "") -> str:
    """Each window's rows are averaged anew."""
    return f"{name} AS (SELECT w.series_id, w.w{extra}, CASE WHEN avg(l.lr) > 0 THEN 1 - avg(l.lp) / avg(l.lr) END AS skill FROM wn w JOIN {losses} l ON l.series_id = w.series_id AND l.k >= w.s AND l.k < w.e GROUP BY ALL)"


_NORMAL = f"(sqrt(-2 * ln(1 - {uniform_sql(chr(39) + 'noisea' + chr(39), 'series_id', 'k')})) * cos(2 * pi() * {uniform_sql(chr(39) + 'noiseb' + chr(39), 'series_id', 'k')}))"
KILLS = f"""{OOS}{EPS_BODY.replace('FROM bars', 'FROM (SELECT series_id, date, pos, close FROM bars)')},
ro AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS k, p, y, clim, pow(p - y, 2) AS lp, pow(clim - y, 2) AS lr FROM oos),
st AS (SELECT r.series_id, r.k AS s, r.date AS start, (r.date + INTERVAL {kills.MONTHS} MONTH)::DATE AS until FROM ro r WHERE k % {kills.STEP} = 0 AND (r.date + INTERVAL {kills.MONTHS} MONTH)::DATE <= (SELECT max(x.date) FROM ro x WHERE x.series_id = r.series_id)),
wn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s) - 1 AS w FROM (SELECT *, (SELECT count(*) FROM ro x WHERE x.series_id = st.series_id AND x.date < st.until) AS e FROM st) WHERE e - s >= {kills.BLOCK}),
{_skill_sql('sk', 'ro')},
ns AS (SELECT series_id, k, lr, pow(greatest(1e-6, least(1 - 1e-6, clim + sd * z)) - y, 2) AS lp FROM (SELECT *, {_NORMAL} AS z, stddev_samp(p - clim) OVER (PARTITION BY series_id) AS sd FROM ro)), {_skill_sql('sn', 'ns')},
bs AS (SELECT *, unnest(range(0, {kills.SHUFFLES})) AS shuffle FROM (SELECT series_id, k // {kills.BLOCK} AS b, list(p ORDER BY k) AS ps FROM ro GROUP BY 1, 2)),
sq AS (SELECT series_id, shuffle, flatten(list(ps ORDER BY {uniform_sql(chr(39) + 'shuffle' + chr(39), 'series_id', 'shuffle', 'b')}, b)) AS ps FROM bs GROUP BY 1, 2),
sl AS (SELECT r.series_id, r.k, q.shuffle, pow(q.ps[r.k + 1] - r.y, 2) AS lp, r.lr FROM ro r JOIN sq q USING (series_id)), {_skill_sql('ss', 'sl', ', l.shuffle')},
wc AS (SELECT series_id, count(*) AS n, least(count(*), {kills.PICKED}) AS m FROM wn GROUP BY 1),
pk AS (SELECT DISTINCT series_id, CAST(CASE WHEN m > 1 THEN round_even(j * (n - 1) / (m - 1), 0) ELSE 0 END AS BIGINT) AS w FROM (SELECT *, unnest(range(0, m)) AS j FROM wc)),
pr2 AS (SELECT w.series_id, w.w, r.k, r.lp, r.lr FROM pk JOIN wn w USING (series_id, w) JOIN ro r ON r.series_id = w.series_id AND r.k >= w.s AND r.k < w.e), {bootstrap_sql('bo', 'pr2', 'series_id, w', 'lp, lr', kills.DRAWS, '1 - {0} / nullif({1}, 0)', order='k')},
br AS (SELECT e.series_id, b.date FROM ep e JOIN bars b ON b.series_id = e.series_id AND b.pos = e.breach_pos WHERE b.date <= (SELECT max(x.date) FROM ro x WHERE x.series_id = e.series_id)),
mo AS (SELECT w.series_id, w.w, w.start, (SELECT list(b.date ORDER BY b.date) FROM br b WHERE b.series_id = w.series_id AND b.date >= w.start)[{kills.EPISODES}] AS stop FROM wn w),
mm AS (SELECT series_id, (year(stop) - year(start)) * 12 + month(stop) - month(start) AS months FROM mo)"""


@query(f"""WITH {KILLS}
SELECT a.series_id, n_windows, {r6('false_kill_share')} AS false_kill_share, {r6('skill_p10')} AS skill_p10, {r6('skill_p50')} AS skill_p50, {r6('skill_p90')} AS skill_p90, {r6('skill_mean')} AS skill_mean, coalesce(ci_windows, -1) AS ci_windows, {r6('validated_share')} AS validated_share, {r6('noise_pass')} AS noise_pass, {r6('shuffle_pass')} AS shuffle_pass, {r6('1 - shuffle_pass')} AS power, reached, censored, {r6('months_p10')} AS months_p10, {r6('months_p50')} AS months_p50, {r6('months_p90')} AS months_p90
FROM (SELECT series_id, count(*) AS n_windows, avg(CAST(skill <= 0 AS DOUBLE)) AS false_kill_share, quantile_cont(skill, 0.1) AS skill_p10, quantile_cont(skill, 0.5) AS skill_p50, quantile_cont(skill, 0.9) AS skill_p90, avg(skill) AS skill_mean FROM sk WHERE skill IS NOT NULL GROUP BY 1) a
LEFT JOIN (SELECT series_id, count(*) AS ci_windows, avg(CAST(low > 0 AS DOUBLE)) AS validated_share FROM bo WHERE low IS NOT NULL GROUP BY 1) USING (series_id) LEFT JOIN (SELECT series_id, avg(CAST(skill > 0 AS DOUBLE)) AS noise_pass FROM sn WHERE skill IS NOT NULL GROUP BY 1) USING (series_id)
LEFT JOIN (SELECT series_id, avg(x) AS shuffle_pass FROM (SELECT series_id, shuffle, avg(CAST(skill > 0 AS DOUBLE)) AS x FROM ss WHERE skill IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (series_id)
LEFT JOIN (SELECT series_id, count(months) AS reached, count(*) - count(months) AS censored, quantile_cont(months, 0.1) AS months_p10, quantile_cont(months, 0.5) AS months_p50, quantile_cont(months, 0.9) AS months_p90 FROM mm GROUP BY 1) USING (series_id)""")
def kill_replay(spark, sf):
    """The rule at every 21st session: false kills, validations, both nulls, and how long the eighth fall takes."""
    close = market.index_close(spark, sf)
    falls = paths.episodes(close, 0.05).select(SERIES, F.col("breach_pos").alias("pos")).join(close.select(SERIES, "pos", "date"), [SERIES, "pos"])
    oos = _oos(spark, sf)
    ends = oos.groupBy(SERIES).agg(F.max("date").alias("last"))
    got = kills.replayed(oos, falls.join(ends, SERIES).filter(F.col("date") <= F.col("last")).select(SERIES, "date"))
    return got.withColumn("ci_windows", F.coalesce("ci_windows", F.lit(-1)))


# ---- reference distributions ------------------------------------------------------------------------------------


def _panels(spark, sf):
    """Values of eight panels at each session: probabilities, skills of windows, exposure, errors and biases, features."""
    d = _oos(spark, sf)
    w = lambda k: expr.trailing(k)
    err, bias = F.abs(F.ln("rv22") - F.lit(math.log(0.17))), F.col("p") - F.col("clim")
    gain = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2)).over(w(252))
    full = lambda c, k: F.when(F.count(F.lit(1)).over(w(k)) == k, c)
    weight = expr.clip(0.1 / F.col("rv22"), 0.25, 1.0)
    values = {
        "p_level": F.col("p"), "skill_252": full(1 - gain("p") / F.nullif(gain("clim"), F.lit(0.0)), 252), "exposure": weight, "at_floor": (weight <= 0.25 + 1e-9).cast("double"), "log_mae_60": full(F.avg(err).over(w(60)), 60),
        "bias_60": full(F.avg(bias).over(w(60)), 60), "x_clim": F.col("clim"), "x_rv22": F.ln("rv22"),
    }
    d = d.withColumns({f"v_{n}": v for n, v in values.items()})
    return reference.panels(d, {n: F.col(f"v_{n}") for n in values})


PANELS = OOS + f""", pw AS (SELECT series_id, pos, p AS p_level, CASE WHEN count(*) OVER y = 252 THEN 1 - avg(pow(p - y, 2)) OVER y / nullif(avg(pow(clim - y, 2)) OVER y, 0) END AS skill_252, least(1.0, greatest(0.25, 0.1 / rv22)) AS exposure, CASE WHEN count(*) OVER q = 60 THEN avg(abs(ln(rv22) - {math.log(0.17)!r}::DOUBLE)) OVER q END AS log_mae_60,
CASE WHEN count(*) OVER q = 60 THEN avg(p - clim) OVER q END AS bias_60, clim AS x_clim, ln(rv22) AS x_rv22 FROM oos WINDOW y AS (PARTITION BY series_id ORDER BY pos ROWS 251 PRECEDING), q AS (PARTITION BY series_id ORDER BY pos ROWS 59 PRECEDING)),
pn AS (SELECT series_id, pos, unnest([{", ".join(f"{{'panel': '{n}', 'value': ({x})::DOUBLE}}" for n, x in (("p_level", "p_level"), ("skill_252", "skill_252"), ("exposure", "exposure"), ("at_floor", "CASE WHEN exposure <= 0.25 + 1e-9 THEN 1 ELSE 0 END"), ("log_mae_60", "log_mae_60"), ("bias_60", "bias_60"), ("x_clim", "x_clim"), ("x_rv22", "x_rv22")))}]) AS x FROM pw),
pv AS (SELECT series_id, pos, x.panel AS panel, x.value AS value FROM pn WHERE x.value IS NOT NULL)"""
_Q = lambda q: f"(list(value ORDER BY value))[greatest(1, CAST(ceil({q} * count(*) - 1e-9) AS BIGINT))]"


@query(f"WITH {PANELS} SELECT coalesce(series_id, 'all') AS series_id, panel, count(*) AS n, {r6('avg(value)')} AS mean, {r6('min(value)')} AS low, {r6('max(value)')} AS high, {', '.join(f'{r6(_Q(q))} AS p{round(100 * q):02d}' for q in reference.QUANTILES)} FROM pv GROUP BY GROUPING SETS ((series_id, panel), (panel))")
def reference_panels(spark, sf):
    """Distributions of all panels, by series and over all."""
    return reference.quantiles(reference.sketches(_panels(spark, sf))).withColumn(SERIES, F.coalesce(SERIES, F.lit("all")))
_RANK = f"(floor(count(*) {{1}} * {reference.GRID} / count(*) {{0}} + 1e-9) / {reference.GRID})"


@query(f"""WITH {PANELS}, li AS (SELECT series_id, panel, last(value ORDER BY pos) AS value FROM pv GROUP BY 1, 2)
SELECT l.series_id, l.panel, {r6('l.value')} AS value, {r6(_RANK.format("FILTER (WHERE p.series_id = l.series_id)", "FILTER (WHERE p.series_id = l.series_id AND p.value <= l.value)"))} AS own_rank, {r6(_RANK.format("", "FILTER (WHERE p.value <= l.value)"))} AS all_rank FROM li l JOIN pv p USING (panel) GROUP BY l.series_id, l.panel, l.value""")
def reference_ranks(spark, sf):
    """Where each series' latest value of a panel stands among the past ones."""
    values = _panels(spark, sf)
    live = values.groupBy(SERIES, "panel").agg(F.max_by("value", "pos").alias("value"))
    return reference.ranks(live, reference.sketches(values))


# ---- summary of the rule ----------------------------------------------------------------------------------------

SUMMARY = f"""{FRAME_REPLAY}, {FWD.format(src='px')}, sj AS (SELECT t.series_id, t.variant, t.tone, t.pos, t.date, fwd_ret_20 AS r20, fwd_ret_60 AS r60, fwd_maxdd_20 AS d20, fwd_maxdd_60 AS d60, CAST(t.tone IN ('buy', 'hold', 'neutral') AS INT) AS up, CASE WHEN t.tone <> lag(t.tone) OVER (PARTITION BY t.series_id, t.variant ORDER BY t.pos) THEN 1 ELSE 0 END AS sw FROM tf t JOIN lab USING (series_id, pos))"""


@query(f"""WITH {SUMMARY}, g AS (SELECT series_id, variant, tone, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(r20) AS realized_20, avg(CASE WHEN r20 IS NOT NULL THEN CAST(CAST(r20 > 0 AS INT) = up AS DOUBLE) END) AS hit_20, avg(CASE WHEN r60 IS NOT NULL THEN CAST(CAST(r60 > 0 AS INT) = up AS DOUBLE) END) AS hit_60, avg(CAST(r20 > 0 AS DOUBLE)) AS baseline_20, avg(CAST(r60 > 0 AS DOUBLE)) AS baseline_60,
avg(r20) AS mean_ret_20, quantile_cont(r20, 0.1) AS ret_p10, avg(CAST(d20 <= -0.05 AS DOUBLE)) AS dd5_20, avg(CAST(d60 <= -0.10 AS DOUBLE)) AS dd10_60, sum(sw) AS switches, avg(CAST(tone IN ('caution', 'reduce') AS DOUBLE)) AS warn_share FROM sj GROUP BY GROUPING SETS ((series_id, variant, tone), (series_id, variant)))
SELECT series_id, variant, coalesce(tone, 'all') AS tone, n, {r6('n / max(n) OVER (PARTITION BY series_id, variant)')} AS share, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, realized_20, {r6('hit_20')} AS hit_20, {r6('hit_60')} AS hit_60, {r6('baseline_20')} AS baseline_20, {r6('baseline_60')} AS baseline_60, {r6('mean_ret_20')} AS mean_ret_20, {r6('ret_p10')} AS ret_p10, {r6('dd5_20')} AS dd5_20, {r6('dd10_60')} AS dd10_60, {r6('dd5_20 * (1 - dd5_20)')} AS brier_clim, CAST(switches AS BIGINT) AS switches, {r6('switches * 252.0 / max(n) OVER (PARTITION BY series_id, variant)')} AS switches_a_year, {r6('warn_share')} AS warn_share FROM g""")
def rule_summary(spark, sf):
    """By series and variant, for each tone and for all: days, hits against always-up, falls, and changes of tone."""
    close = market.index_close(spark, sf)
    replayed = timeframes.replay(timeframes.metrics(_days(spark, sf), [f"part{i}" for i in range(PARTS)]))
    return evaluation.rule_summary(replayed, vol.targets(close).drop("date"))


# ---- paths whose SQL takes one step a round ---------------------------------------------------------------------


def _sizing_sql(variants: str, path: str) -> str:
    """Executed weights row by row: each path takes one step a round."""
    goal = "round(round_even(n.t / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 10)"
    step = lambda missing, init, cut, weekly, hold: f"CASE WHEN n.t IS NULL OR n.m IS NULL THEN {missing} WHEN x.w IS NULL THEN {init} WHEN x.m IS NOT NULL AND n.m < x.m THEN {cut} WHEN n.week_end AND abs(n.t - x.w) >= 0.1::DOUBLE THEN {weekly} ELSE {hold} END"
    first = lambda missing, init: f"CASE WHEN n.t IS NULL OR n.m IS NULL THEN {missing} ELSE {init} END"
    return f"""WITH RECURSIVE {DECIDED}, sz AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY pos)) AS lr FROM px), er AS (SELECT series_id, pos, lr AS r, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM sz WHERE lr IS NOT NULL), s60 AS (SELECT series_id, var_samp(r) AS v0 FROM er WHERE i <= 60 GROUP BY 1),
acc AS (SELECT a.series_id, a.pos, sum(0.06 * pow(0.94, a.i - b.i) * b.r * b.r) AS s FROM er a JOIN er b ON a.series_id = b.series_id AND b.i > 60 AND b.i <= a.i AND a.i - b.i < 800 GROUP BY 1, 2),
sg AS (SELECT p.series_id, p.pos, CASE WHEN er.i >= 60 THEN sqrt(252 * (pow(0.94, er.i - 60) * v0 + coalesce(s, 0))) END AS sigma FROM px p LEFT JOIN er ON er.series_id = p.series_id AND er.pos = p.pos LEFT JOIN acc ON acc.series_id = p.series_id AND acc.pos = p.pos LEFT JOIN s60 ON s60.series_id = p.series_id),
tg AS (SELECT g.series_id, g.pos, g.pos % 5 = 0 AS week_end, CASE d.state WHEN 'reduce' THEN 0.25::DOUBLE WHEN 'caution' THEN 0.5::DOUBLE WHEN 'normal' THEN 1.0::DOUBLE END AS m, CASE WHEN sigma IS NOT NULL THEN least(greatest(0.1::DOUBLE / sigma, 0.25::DOUBLE), 1.0::DOUBLE) END AS wv FROM sg g LEFT JOIN dc d ON d.series_id = g.series_id AND d.pos = g.pos),
tt AS (SELECT *, CASE WHEN wv * m IS NOT NULL THEN least(greatest(wv * m, 0.25::DOUBLE), 1.0::DOUBLE) END AS t0 FROM (SELECT series_id, pos, week_end, m, wv FROM tg)),
vn(variant, scale) AS (VALUES {variants}), rw AS (SELECT {path} AS path, pos, week_end, m, CASE WHEN scale IS NULL THEN t0 WHEN t0 IS NOT NULL THEN least(greatest(t0 * scale, 0.25::DOUBLE), 1.0::DOUBLE) END AS t, row_number() OVER (PARTITION BY {path} ORDER BY pos) AS i FROM tt, vn),
pa AS (SELECT n.path, n.pos, n.i, {first('NULL', goal)} AS w, n.m AS m, {first("'input_missing'", "'init'")} AS reason FROM rw n WHERE i = 1 UNION ALL SELECT n.path, n.pos, n.i, {step('x.w', goal, f'least({goal}, x.w)', goal, 'x.w')}, coalesce(n.m, x.m), {step("'input_missing'", "'init'", "'escalation'", "'weekly'", "'hold'")} FROM pa x JOIN rw n ON n.path = x.path AND n.i = x.i + 1)
SELECT path AS {'series_id' if 'variant' not in path else 'path'}, pos, {r6('w')} AS w_exec, reason FROM pa"""


QUERIES["sizing_path"] = QUERIES["sizing_path"][0], _sizing_sql("('base', NULL::DOUBLE)", "series_id")
QUERIES["sizing_variants"] = QUERIES["sizing_variants"][0], _sizing_sql("('base', 1.0::DOUBLE), ('low', 0.6::DOUBLE), ('high', 1.5::DOUBLE)", "concat(variant, '/', series_id)")
_A, _B, _C = (f"{2 / (k + 1)!r}::DOUBLE" for k in (12, 26, 9))
QUERIES["macd_phases"] = QUERIES["macd_phases"][0], f"""WITH RECURSIVE {PX}, m AS (SELECT series_id, pos, close AS f, close AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS h, 0 AS run FROM px WHERE pos = 1
UNION ALL SELECT series_id, pos, f, s, g, f - s - g, CASE WHEN mv <> 0 AND run * mv > 0 THEN run + mv ELSE mv END FROM (SELECT *, CASE WHEN f - s - g > h THEN 1 WHEN f - s - g < h THEN -1 ELSE 0 END AS mv FROM (SELECT *, g0 + {_C} * (f - s - g0) AS g FROM (
  SELECT n.series_id, n.pos, m.f + {_A} * (n.close - m.f) AS f, m.s + {_B} * (n.close - m.s) AS s, m.g AS g0, m.h, m.run FROM m JOIN px n ON n.series_id = m.series_id AND n.pos = m.pos + 1))))
SELECT series_id, pos, {r6('h')} AS hist, CAST(run AS BIGINT) AS run, CASE WHEN h < 0 THEN CASE WHEN run >= 3 THEN 'turn' ELSE 'down' END WHEN h > 0 AND run <= -3 THEN 'roll' ELSE 'up' END AS phase FROM m"""
