"""Upserts, guards, the append-only ledger with backfill, drift alarms and the kill rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, ahead, full, series, trailing

LAG_LIMIT, SHRINK = 3, 0.9


def upsert_cells(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win cell by cell; where they are missing the old ones stay."""
    columns = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, keys, "full")
    return both.select(*keys, *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns))


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new row replaces the old row of its keys whole."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def guard_phantom(prices: DataFrame, truth: str, always: tuple[str, ...] = ()) -> DataFrame:
    """Drops rows after the truth series' last date, except of series that trade every day."""
    last = prices.filter(F.col(SERIES) == truth).agg(F.max("date").alias("_last"))
    # one row
    return prices.join(F.broadcast(last)).filter((F.col("date") <= F.col("_last")) | F.col(SERIES).isin(*always)).drop("_last")


def stale(prices: DataFrame, truth: str, limit: int = LAG_LIMIT) -> DataFrame:
    """Series whose last date lies at least ``limit`` sessions of the truth series back, with that lag."""
    dates = prices.filter(F.col(SERIES) == truth).select(F.col("date").alias("session"))
    last = prices.groupBy(SERIES).agg(F.max("date").alias("last_date"))
    ends = dates.agg(F.count("*").alias("all"))
    # the running number of sessions up to each date, met as of the last date
    numbered = dates.withColumn("k", F.row_number().over(Window.orderBy("session")))
    met = last.join(F.broadcast(numbered), F.col("session") <= F.col("last_date"), "left").groupBy(SERIES, "last_date").agg(F.coalesce(F.max("k"), F.lit(0)).alias("seen"))
    return met.join(F.broadcast(ends)).select(SERIES, "last_date", (F.col("all") - F.col("seen")).alias("lag")).filter(F.col("lag") >= limit)


def regressions(old: DataFrame, new: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """Series that a rebuild lost, shortened below ``shrink`` of their rows, or set back in time."""
    stats = lambda df, n: df.groupBy(SERIES).agg(F.count("*").alias(f"n_{n}"), F.max("date").alias(f"last_{n}"))
    met = stats(old, "old").join(stats(new, "new"), SERIES, "left")
    why = F.when(F.col("n_new").isNull(), "lost").when(F.col("n_new") < shrink * F.col("n_old"), "shrunk").when(F.col("last_new") < F.col("last_old"), "moved_back")
    return met.withColumn("reason", why).filter("reason is not null")


def asof(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left with the value of right's latest date at or before each of its dates: a union and one window, no range join."""
    both = left.select(SERIES, "date", F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value)).unionByName(right.select(SERIES, "date", F.lit(0).alias("_side"), value))
    w = Window.partitionBy(SERIES).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_side = 1").drop("_side")


def append(ledger: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("asof", "variant")) -> DataFrame:
    """The ledger with the rows whose keys it lacks; the first of equal keys in rows wins by all columns' order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in rows.columns))
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    fresh = once.join(ledger.select(*keys), list(keys), "left_anti")
    return ledger.unionByName(fresh, allowMissingColumns=True)


def backfill(ledger: DataFrame, closes: DataFrame, horizons: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Outcome columns filled once their horizon is known; what is there is never rewritten."""
    c, known = F.col("close"), closes
    for h in horizons:
        known = known.withColumn(f"new_ret_{h}", F.round(F.lead("close", h).over(series()) / c - 1, 6))
    known = known.withColumn("new_dd", F.round(full(c, F.min("close"), ahead(20), 20) / c - 1, 6))
    met = ledger.join(known.select(SERIES, F.col("date").alias("asof"), *(f"new_ret_{h}" for h in horizons), "new_dd"), [SERIES, "asof"], "left")
    old = lambda n, t: F.col(n) if n in ledger.columns else F.lit(None).cast(t)
    out = {f"fwd_ret_{h}": F.coalesce(old(f"fwd_ret_{h}", "double"), F.col(f"new_ret_{h}")) for h in horizons}
    dd = F.when(F.col("new_dd").isNotNull(), (F.col("new_dd") <= -0.05).cast("int"))
    met = met.withColumns(out | {"y_dd5_20": F.coalesce(old("y_dd5_20", "int"), dd)})
    return met.drop("new_dd", *(f"new_ret_{h}" for h in horizons))


def summary(ledger: DataFrame) -> DataFrame:
    """Counts, hit rates and mean outcomes by tone, by variant and by both."""
    sets = [[F.col("variant"), F.col("tone")], [F.col("variant")], [F.col("tone")]]
    hit = F.avg((F.col("fwd_ret_20") > 0).cast("double"))
    return ledger.groupingSets(sets, "variant", "tone").agg(F.count("*").alias("n"), F.count("fwd_ret_20").alias("realized"), hit.alias("hit_20"), F.avg("fwd_ret_20").alias("mean_20"), F.avg(F.col("y_dd5_20").cast("double")).alias("dd_rate"))


def missing_sessions(ledger: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions between the ledger's first and last day that it lacks, by series."""
    spans = ledger.groupBy(SERIES).agg(F.min("asof").alias("low"), F.max("asof").alias("high"))
    wanted = calendar.select("date").join(F.broadcast(spans), F.col("date").between(F.col("low"), F.col("high"))).select(SERIES, "date")
    return wanted.join(ledger.select(SERIES, F.col("asof").alias("date")), [SERIES, "date"], "left_anti")


def alarms(live: DataFrame) -> DataFrame:
    """series_id, pos, code, value of the drift alarms that ring: only full windows are judged.

    live has p, y, clim, ln_err (log volatility forecast error), w (weight) and changed.
    """
    brier, ref = F.pow(F.col("p") - F.col("y"), 2), F.pow(F.col("clim") - F.col("y"), 2)
    mean = lambda x, k: full(x, F.avg(x), trailing(k), k)
    skill = lambda k: 1 - mean(brier, k) / F.nullif(mean(ref, k), F.lit(0.0))
    checks = {
        "D1": (mean(F.col("p"), 120), lambda v: ~v.between(0.04, 0.35)),
        "D2_red": (skill(756), lambda v: v < -0.05),
        "D2_yellow": (skill(252), lambda v: v < -0.10),
        "D3": (mean(F.abs("ln_err"), 60), lambda v: v > 0.50),
        "D5": (mean(F.col("w"), 252), lambda v: v < 0.30),
        "D6": (full(F.col("changed"), F.sum(F.col("changed").cast("double")), trailing(252), 252), lambda v: v > 24),
    }
    found = live.withColumns({code: F.round(v, 6) for code, (v, _) in checks.items()})
    rung = F.array(*(F.when(test(F.col(code)), F.struct(F.lit(code).alias("code"), F.col(code).alias("value"))) for code, (_, test) in checks.items()))
    return found.select(SERIES, "pos", F.explode(F.filter(rung, lambda a: a.isNotNull())).alias("a")).select(SERIES, "pos", "a.code", "a.value")


def kill_stage(months: Column, episodes: Column) -> Column:
    """What the kill rule may decide: nothing before 36 months, then from 8 episodes or 60 months on."""
    return F.when(months < 36, "waiting").when((episodes >= 8) | (months >= 60), "evaluate").otherwise("extended")


def kill_status(live: DataFrame, episodes: DataFrame) -> DataFrame:
    """months, episodes, skill, stage and verdict by series: killed if the skill isn't positive when the stage evaluates."""
    brier, ref = F.pow(F.col("p") - F.col("y"), 2), F.pow(F.col("clim") - F.col("y"), 2)
    got = live.groupBy(SERIES).agg(
        ((F.year(F.max("date")) - F.year(F.min("date"))) * 12 + F.month(F.max("date")) - F.month(F.min("date"))).alias("months"),
        (1 - F.avg(brier) / F.nullif(F.avg(ref), F.lit(0.0))).alias("skill"), F.min("pos").alias("first_pos"),
    )
    seen = episodes.join(got.select(SERIES, "first_pos"), SERIES).filter(F.col("breach_pos") >= F.col("first_pos")).groupBy(SERIES).agg(F.count("*").alias("episodes"))
    got = got.join(seen, SERIES, "left").withColumn("episodes", F.coalesce("episodes", F.lit(0))).withColumn("stage", kill_stage(F.col("months"), F.col("episodes")))
    verdict = F.when(F.col("stage") != "evaluate", "continue").when(F.col("skill") <= 0, "kill").otherwise("pass")
    return got.select(SERIES, "months", "episodes", "skill", "stage", verdict.alias("verdict"))


def replay_check(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """By column: rows that differ beyond the tolerance, and values that only one side has."""
    met = a.alias("a").join(b.alias("b"), [SERIES, "pos"], "full")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("double").alias("x"), F.col(f"b.{c}").cast("double").alias("y")) for c in columns))
    d = met.select(F.explode(cells).alias("c")).select("c.*")
    return d.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("differ"), F.count_if(F.col("y").isNull() & F.col("x").isNotNull()).alias("only_a"), F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("only_b"))
