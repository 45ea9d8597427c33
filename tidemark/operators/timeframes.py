"""The rule engine on daily, weekly and monthly bars, as each session saw them.

At a session the last week and month are still open: their bar so far counts as a bar (variant ``faithful``) or not yet
(``completed``). All bars lie in a window of two years that ends at the session, so averages start anew at the window's
first bar; and each score is compared with the one some sessions before (``CUTS``), seen from the same window.

One ordered fold per series does this: it holds the bars closed so far with the averages' running state, and beside them
the open bar's state, which every session replaces. A window's averages follow from the running ones, as what came before
the window fades by known powers, so a session costs the same whatever the window's length. Memory is two years of a
series.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, series, trailing, whole
from tidemark.operators import rules
from tidemark.operators.events import around
from tidemark.operators.folds import fold
from tidemark.operators.sessions import week

#: Bars that returns look back, bars that confirm a turn, bars of the coin's momentum, sessions between a score and the one before.
LOOKBACK = {"daily": 5, "weekly": 4, "monthly": 3}
CONFIRM = {"daily": 3, "weekly": 2, "monthly": 2}
MOMENTUM = {"daily": 7, "weekly": 4, "monthly": 3}
CUTS = {"daily": 3, "weekly": 5, "monthly": 21}
FG_BEFORE = {"daily": 1, "weekly": 5, "monthly": 21}
#: Signals of the daily frame alone, the least change of a score, the trend's sessions, a closing streak's window, bars of a leader.
DAILY_ONLY = ("fg", "ma", "eod", "lead")
TREND, SMA, STREAK, LEAST_BARS = 0.08, 180, 30, 65
MONTHS = 24
FAST, SLOW, SIGNAL = 12, 26, 9
#: A move of the histogram below this share of the price is none.
STILL = 1e-12
FIELDS = "rs double, phase string, run long, vix double, vix_chg double, btc_mom double"
#: (frame, variant, whether rewound)
VIEWS = [(tf, v, back) for tf, v, back in product(LOOKBACK, ("faithful", "completed"), (0, 1)) if tf != "daily" or v == "faithful"]


class Averages:
    """MACD's three averages over bars, and its histogram over those from a later bar on."""

    fast, slow, signal = (2 / (k + 1) for k in (FAST, SLOW, SIGNAL))

    @classmethod
    def step(cls, v: tuple | None, x: float) -> tuple:
        if v is None:
            return x, x, 0.0, x
        f, s = v[0] + cls.fast * (x - v[0]), v[1] + cls.slow * (x - v[1])
        return f, s, v[2] + cls.signal * (f - s - v[2]), x

    @classmethod
    def histogram(cls, v: tuple, first: tuple, k: int) -> float:
        """Of a bar with state v, k bars after the window's first one, whose running state is ``first``."""
        if not k:
            return 0.0
        p, r, q = 1 - cls.fast, 1 - cls.slow, 1 - cls.signal
        f, s = first[3] - first[0], first[3] - first[1]
        pk, rk, qk = p**k, r**k, q**k
        macd = v[0] - v[1] + f * pk - s * rk
        signal = v[2] - first[2] * qk + cls.signal * (f * p * (pk - qk) / (p - q) - s * r * (rk - qk) / (r - q))
        return macd - signal


class Bars:
    """Closed bars of one frame (place of the last session, state), of which those before the window are let go."""

    def __init__(self) -> None:
        self.label = self.open = None
        self.closed: list[tuple[int, tuple]] = []
        self.gone = self.first = 0

    def add(self, place: int, label: int, x: float) -> tuple[int, tuple]:
        """(bars closed before the session's own, the state of the open one)."""
        if label != self.label and self.open is not None:
            self.closed.append(self.open)
        self.label = label
        v = Averages.step(self.closed[-1][1] if self.closed else None, x)
        self.open = (place, v)
        return self.gone + len(self.closed), v

    def starts(self, place: int) -> None:
        """The window begins at a place: bars that end before it aren't in it."""
        while self.first - self.gone < len(self.closed) and self.closed[self.first - self.gone][0] < place:
            self.first += 1
        # the last closed bar stays, as the open one goes on from it
        if (drop := min(self.first - self.gone, len(self.closed) - 1)) > 256:
            del self.closed[:drop]
            self.gone += drop


def views(days: DataFrame, basket: Sequence[str], equal: bool = False) -> DataFrame:
    """series_id, pos and FIELDS of each view (frame, variant, rewound), as columns v<i>_<field> in the order of VIEWS.

    days: series_id, pos, date, close, vix, btc, the closes of ``basket``, week and month (the ends of the session's week
    and month), and week_done and month_done, whether they are over after the session. The basket is the mean of closes
    relative to the window's first session, or with ``equal`` compounds mean returns.
    """
    frames = ("daily", "weekly", "monthly")

    def step(held: dict, row: tuple) -> tuple:
        pos, day, start, close, vix, btc, wk, mo, wk_done, mo_done, *parts = row
        if "rows" not in held or held["rows"] is None:
            held.update(rows=[], base=pos, first=pos, bars={tf: Bars() for tf in frames}, level=1.0)
        rows, bars = held["rows"], held["bars"]
        if equal and rows and None not in parts and None not in rows[-1][4]:
            held["level"] *= 1 + sum(a / b - 1 for a, b in zip(parts, rows[-1][4], strict=True)) / len(parts)
        at = {tf: bars[tf].add(pos, label, close) for tf, label in (("daily", day), ("weekly", wk), ("monthly", mo))}
        rows.append((day, close, vix, btc, parts, at, {"daily": True, "weekly": wk_done, "monthly": mo_done}, held["level"]))
        while rows[held["first"] - held["base"]][0] <= start:
            held["first"] += 1
        for tf in frames:
            bars[tf].starts(held["first"])
        if (drop := held["first"] - held["base"]) > 1024:
            del rows[:drop]
            held["base"] += drop
        base, first = held["base"], rows[held["first"] - held["base"]]

        def view(tf: str, variant: str, back: int) -> tuple:
            seen = pos - CUTS[tf] * back
            if seen < held["first"]:
                return (None,) * 6
            u, all_ = rows[seen - base], bars[tf]
            n, open_ = u[5][tf]
            # bars all_.first .. last: the closed ones, then the open one at n
            last = n if variant == "faithful" or u[6][tf] else n - 1
            if last < all_.first:
                return (None,) * 6
            bar = lambda i: (seen, open_) if i == n else all_.closed[i - all_.gone]
            origin, begun = all_.first, bar(all_.first)[1]
            h = Averages.histogram(bar(last)[1], begun, last - origin)
            still = STILL * close
            h0, run, i = h if abs(h) > still else 0.0, 0, last
            while i > origin:
                before = Averages.histogram(bar(i - 1)[1], begun, i - 1 - origin)
                move = 0 if abs(h - before) <= still else 1 if h > before else -1
                if not move or run * move < 0:
                    break
                run, h, i = run + move, before, i - 1
            phase = "turn" if h0 < 0 and run >= CONFIRM[tf] else "roll" if h0 > 0 and -run >= CONFIRM[tf] else "up" if h0 >= 0 else "down"
            run = max(run, 0) if phase in ("turn", "up") else max(-run, 0)
            now = rows[bar(last)[0] - base]

            def back_by(k: int) -> tuple | None:
                return rows[bar(last - k)[0] - base] if last - k >= origin else None

            def change(value, k: int) -> float | None:  # noqa: ANN001
                then = back_by(k)
                if then is None:
                    return 0.0
                a, b = value(now), value(then)
                return None if a is None or b is None else (a / b - 1) * 100

            def level(r: tuple) -> float | None:
                if None in r[4] or None in first[4]:
                    return None
                return sum(a / b for a, b in zip(r[4], first[4], strict=True)) / len(r[4])

            of_basket, of_close = change((lambda r: r[7]) if equal else level, LOOKBACK[tf]), change(lambda r: r[1], LOOKBACK[tf])
            then = back_by(LOOKBACK[tf])
            vix_then = now[2] if then is None else then[2]
            vix_chg = None if now[2] is None or vix_then is None else now[2] - vix_then
            return None if of_basket is None else of_basket - of_close, phase, run, now[2], vix_chg, change(lambda r: r[3], MOMENTUM[tf])

        return tuple(x for v in VIEWS for x in view(*v))

    outputs = ", ".join(f"v{i}_{f}" for i in range(len(VIEWS)) for f in FIELDS.split(", "))
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    rows = days.select(
        SERIES, "pos", number("date").alias("day"), number(F.add_months("date", -MONTHS)).alias("start"), "close", "vix", "btc", number("week").alias("week"), number("month").alias("month"), "week_done", "month_done", *basket,
    ).withColumn("place", F.col("pos"))
    return fold(rows, ["place", "day", "start", "close", "vix", "btc", "week", "month", "week_done", "month_done", *basket], outputs, step, {"rows": None})


def with_period_ends(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (date) with week and month, their last days, and whether they are over after the session, by the exchange's calendar."""
    near = around(days.select("date"), calendar).select("date", F.col("session").isNotNull().alias("_open"), "next_session")
    d = days.withColumns({"week": week(F.col("date")), "month": F.last_day("date")}).join(near, "date")
    over = lambda end: (F.col("date") == F.col(end)) | F.coalesce(F.col("_open") & (F.col("next_session") > F.col(end)), F.lit(False))
    return d.withColumns({"week_done": over("week"), "month_done": over("month")}).drop("_open", "next_session")


def leaders(watch: DataFrame, days: DataFrame) -> DataFrame:
    """series_id, pos, watched, lead_below, lead_above: series of the watch list with enough bars, and those that lead.

    watch: series_id, ticker, pos, close. Below trend a leader falls less than the index from its high of 60 sessions and
    rises over five; above it beats the index over 20 sessions by more than three points.
    """
    by = Window.partitionBy(SERIES, "ticker").orderBy("pos")
    high = lambda w: F.max("close").over(w.rowsBetween(-59, 0))
    ret = lambda w, k: (F.col("close") / F.lag("close", k).over(w) - 1) * 100
    one = watch.withColumns({"n": F.row_number().over(by), "dd": F.col("close") / high(by) - 1, "r5": ret(by, 5), "r20": ret(by, 20)})
    full = F.count("*").over(trailing(60)) == 60
    index = days.select(SERIES, "pos", F.when(full, F.col("close") / high(series()) - 1).alias("index_dd"), F.coalesce(ret(series(), 20), F.lit(0.0)).alias("index_r20"))
    met = one.filter(F.col("n") >= LEAST_BARS).join(index, [SERIES, "pos"])
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return met.groupBy(SERIES, "pos").agg(
        F.count("*").alias("watched"), count((F.col("dd") >= 0.6 * F.col("index_dd")) & (F.col("r5") > 0)).alias("lead_below"), count(F.col("r20") - F.col("index_r20") > 3).alias("lead_above")
    )


def run_length(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with the number of true flags since the last false one, up to each row; null ones count for nothing."""
    d = df.withColumn("_flag", flag).withColumn("_broken", F.sum(F.when(~F.col("_flag"), 1).otherwise(0)).over(whole()))
    since = Window.partitionBy(SERIES, "_broken").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(since)).drop("_flag", "_broken")


def metrics(days: DataFrame, basket: Sequence[str], equal: bool = False) -> DataFrame:
    """The rule engine's metrics: one row for each session, frame, variant and rewind (0, or the frame's cut).

    days as for ``views``, and fg (sentiment, null if missing), eod (whether the close was bought, null if unknown),
    watched, lead_below, lead_above. Rows without a trend or with missing inputs are left out.
    """
    past = lambda k: F.last("fg", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -k))
    sma = F.when(F.count("close").over(trailing(SMA)) == SMA, F.avg("close").over(trailing(SMA)))
    d = run_length(run_length(days.withColumn("sma", sma), F.col("eod"), "eod_run"), F.col("btc") > F.lag("btc").over(series()), "btc_run")
    d = d.withColumns({f"fg_{tf}": F.when(F.col("pos") > k, F.coalesce(F.bround(F.col("fg") - past(k)), F.lit(0.0))).otherwise(0.0) for tf, k in FG_BEFORE.items()})
    daily = {}
    for tf, k in {**{tf: CUTS[tf] for tf in CUTS}, "now": 0}.items():
        at = (lambda c, k=k: F.lag(c, k).over(series())) if k else (lambda c: F.col(c))
        daily[tf] = F.struct(
            at("close").alias("close"), at("sma").alias("sma"), F.when(F.col("pos") > k, F.least(at("eod_run"), F.lit(STREAK - k))).alias("streak"), at("lead_below").alias("lead_below"), at("lead_above").alias("lead_above"), at("btc_run").alias("btc_up")
        )
    d = d.withColumns({f"at_{tf}": c for tf, c in daily.items()})
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    both = d.join(views(days, basket, equal), [SERIES, "pos"])
    one = [
        F.struct(
            F.lit(tf).alias("frame"), F.lit(v).alias("variant"), F.lit(CUTS[tf] * back).alias("cut"), *(F.col(f"v{i}_{f}").alias(f) for f in fields), F.col(f"fg_{tf}").alias("fg_chg"), F.col(f"at_{tf}" if back else "at_now").alias("at"),
        )
        for (tf, w, back), i in zip(VIEWS, range(len(VIEWS)), strict=True) for v in (("faithful", "completed") if tf == "daily" else (w,))
    ]
    x = both.select(SERIES, "pos", "date", "fg", F.col("eod").isNull().alias("no_eod"), (F.coalesce("watched", F.lit(0)) == 0).alias("no_lead"), F.explode(F.array(*one)).alias("x"))
    x = x.select(SERIES, "pos", "date", "fg", "no_eod", "no_lead", "x.*").withColumn("ma", (F.col("at.close") / F.col("at.sma") - 1) * 100)
    n = F.when(F.col("ma") <= 0, F.col("at.lead_below")).otherwise(F.col("at.lead_above"))
    out = x.select(SERIES, "pos", "date", "frame", "variant", "cut", "ma", "rs", "phase", "run", F.when(F.isnull("fg"), None).otherwise(F.bround("fg")).alias("fg"), "fg_chg", "vix", "vix_chg", F.col("at.streak").alias("streak"), F.coalesce(n, F.lit(0)).alias("leaders"), "btc_mom", F.col("at.btc_up").alias("btc_up"), "no_eod", "no_lead")
    return out.dropna(subset=["ma", "rs", "phase", "vix", "vix_chg", "btc_mom", "streak"])


def replay(measured: DataFrame) -> DataFrame:
    """Scores, trends and overall states of the three frames, the rule and the tone: one row for each session and variant."""
    s = measured.withColumns({f"s_{k}": v for k, v in rules.assess().items()})
    other = F.col("frame") != "daily"
    missing = {"fg": other | F.col("fg").isNull(), "ma": other, "eod": other | F.col("no_eod"), "lead": other | F.col("no_lead")}
    s = s.withColumn("score", rules.composite(s, missing))
    by = [SERIES, "pos", "date", "variant"]
    value = lambda tf, now: F.max(F.when((F.col("frame") == tf) & ((F.col("cut") == 0) == F.lit(now)), F.col("score")))
    wide = s.groupBy(*by).agg(*(value(tf, now).alias(f"{tf[0]}_{'now' if now else 'then'}") for tf in LOOKBACK for now in (True, False))).dropna()
    change = lambda f: F.col(f"{f}_now") - F.col(f"{f}_then")
    trend = {f"trend_{f}": F.when(change(f) > TREND, 1).when(change(f) < -TREND, -1).otherwise(0) for f in "dwm"}
    wide = wide.withColumns(trend).withColumns({f: rules.overall(F.col(f"{f}_now"), F.col(f"trend_{f}")) for f in "mwd"})
    return rules.with_tone(wide.select(*by, *(F.col(f"{f}_now").alias(f"score_{f}") for f in "dwm"), *trend, "m", "w", "d"))
