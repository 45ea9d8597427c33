"""Members beside the production probability: combination, disagreement, admission by fresh blocks, registry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, ratio, series
from tidemark.operators import bootstrap, scoring

#: Members in order, statuses that combine and those that leave the band, limits.
MEMBERS = ("p2", "h", "m1")
COMBINING, OUT_OF_BAND = ("seed", "admitted"), ("killed", "candidate_rejected")
WIDE, WIDE_SESSIONS = 0.20, 5
BLOCK_MONTHS, LEAST_BLOCKS, AGAIN, WIN_SHARE, LABEL = 3, 11, 4, 8 / 11, 20
HOLDOUT = "2024-09-01"


def member_columns(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """df with m_<member>: the first of its candidate columns that df has; null if it has none."""
    has = set(df.columns)
    return df.withColumns({f"m_{m}": next((F.col(c).cast("double") for c in names if c in has), F.lit(None).cast("double")) for m, names in candidates.items()})


def combined(statuses: dict[str, str]) -> Column:
    """Mean of the members that combine; null if one of them is, or if none combines."""
    names = [f"m_{m}" for m in MEMBERS if statuses.get(m) in COMBINING]
    return sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names) if names else F.lit(None).cast("double")


def long_runs(flag: Column, least: int) -> Column:
    """Whether a row is in a run of true flags of at least ``least`` rows; _i numbers the rows of a series."""
    flag = F.coalesce(flag, F.lit(False))
    before, after = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    last_off = F.coalesce(F.max(F.when(~flag, F.col("_i"))).over(before), F.lit(0))
    next_off = F.coalesce(F.min(F.when(~flag, F.col("_i"))).over(after), F.max("_i").over(Window.partitionBy(SERIES)) + 1)
    return flag & (next_off - last_off - 1 >= least)


def disagreement(df: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """df (p2_lo, p2_hi and member columns) with the band of the members and p2's own, its width, where it comes from, and long wide runs."""
    inside = [F.col(f"m_{m}") for m in MEMBERS if m in statuses and statuses[m] not in OUT_OF_BAND]
    low, high = (F.least(*inside), F.greatest(*inside)) if len(inside) > 1 else (inside[0], inside[0]) if inside else (F.lit(None).cast("double"),) * 2
    d = df.withColumns({"_lo": low, "_hi": high, "_i": F.row_number().over(series())})
    d = d.withColumns({"lo": F.least("p2_lo", "_lo"), "hi": F.greatest("p2_hi", "_hi")}).withColumn("width", F.col("hi") - F.col("lo"))
    wider = (F.col("_lo") < F.col("p2_lo")) | (F.col("p2_lo").isNull() & F.col("_lo").isNotNull()) | (F.col("_hi") > F.col("p2_hi")) | (F.col("p2_hi").isNull() & F.col("_hi").isNotNull())
    d = d.withColumn("source", F.when(F.coalesce(wider, F.lit(False)), "members").otherwise("p2")).withColumn("flag", long_runs(F.col("width") > WIDE, WIDE_SESSIONS))
    return d.drop("_lo", "_hi", "_i")


def fresh_blocks(sessions: DataFrame, starts: DataFrame, months: int = BLOCK_MONTHS, label: int = LABEL) -> DataFrame:
    """Tiles of ``months`` from each series' live start (start) up to its last session: sessions in each, and whether all labels are known.

    Starts in the held-out time give no tile.
    """
    ends = sessions.groupBy(SERIES).agg(F.max("date").alias("end"), F.max("pos").alias("last_pos"))
    s = starts.filter(F.col("start") > F.lit(HOLDOUT).cast("date")).join(ends, SERIES)
    n = F.floor(F.months_between("end", "start") / months).cast("int") + 1
    tiles = s.filter(F.col("start") <= F.col("end")).select(SERIES, "start", "last_pos", F.explode(F.sequence(F.lit(0), n)).alias("k"), "end")
    tiles = tiles.select(SERIES, "last_pos", (F.col("k") + 1).alias("block"), F.add_months("start", F.col("k") * months).alias("first"), F.add_months("start", (F.col("k") + 1) * months).alias("last"), "end").filter(F.col("first") <= F.col("end")).drop("end")
    met = tiles.join(sessions.select(SERIES, "date", "pos"), SERIES).filter((F.col("date") >= F.col("first")) & (F.col("date") < F.col("last")))
    inside = met.groupBy(SERIES, "block").agg(F.count("*").alias("n"), F.max("pos").alias("own_last"))
    got = tiles.join(inside, [SERIES, "block"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "after": F.coalesce(F.col("last_pos") - F.col("own_last"), F.lit(0))})
    return got.select(SERIES, "block", "first", "last", "n", "after", ((F.col("n") > 0) & (F.col("after") >= label)).alias("complete"))


def admission_power(chances: DataFrame, n: int = LEAST_BLOCKS, need: int = 8) -> DataFrame:
    """chances (q and others) with the chance of ``need`` wins in n blocks if each is won with probability q: the tail of a binomial."""
    term = lambda k: F.lit(float(math.comb(n, k))) * F.pow("q", F.lit(k)) * F.pow(1 - F.col("q"), F.lit(n - k))
    return chances.select("*", F.lit(n).alias("n_blocks"), F.lit(need).alias("need"), sum((term(k) for k in range(need + 1, n + 1)), term(need)).alias("p_at_least"))


def admission(oos: DataFrame, candidate: str, admitted: list[str] | None, fresh: bool, draws: int = 4_000) -> DataFrame:
    """By series: blocks that the candidate improves, how many it needs, the interval of its gain, and the verdict.

    oos: block, y and member columns. Only fresh blocks, LEAST_BLOCKS at least, can admit: observed ones reject or leave in
    the shadow, whatever the figures (verdict_raw). Without ``admitted`` the columns in_<member> say who is in, by series.
    """
    there = {m: F.lit(m in admitted) if admitted is not None else F.col(f"in_{m}") for m in MEMBERS}

    def mean(extra: str | None) -> Column:
        total, n = F.lit(0.0), F.lit(0)
        for m in MEMBERS:
            inside = F.lit(True) if m == extra else there[m]
            total, n = total + F.when(inside, F.col(f"m_{m}")).otherwise(0.0), n + inside.cast("int")
        return total / F.nullif(n, F.lit(0))

    d = oos.withColumns({"base": mean(None), "with_c": mean(candidate)}).dropna(subset=["base", "with_c", "y", "block"])
    d = d.withColumns({"la": F.pow(F.col("base") - F.col("y"), 2), "lb": F.pow(F.col("with_c") - F.col("y"), 2)}).withColumn("gain", F.col("la") - F.col("lb"))
    blocks = d.groupBy(SERIES, "block").agg((F.avg("la") - F.avg("lb")).alias("d"))
    wins = blocks.groupBy(SERIES).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("d") > 0).alias("wins")).withColumn("need", F.ceil(F.col("n_blocks") * WIN_SHARE - 1e-9))
    got = wins.join(bootstrap.interval(d, "gain", [SERIES], draws=draws), SERIES)
    raw = F.when((F.col("wins") >= F.col("need")) & (F.col("high") > 0), "ADMIT").otherwise("SHADOW")
    may = F.lit(fresh) & (F.col("n_blocks") >= LEAST_BLOCKS)
    reason = F.when(may, None).when(F.lit(fresh), "too_few_fresh_blocks").otherwise("observed_record_cannot_admit")
    return got.select(SERIES, F.lit(candidate).alias("candidate"), "n", "n_blocks", "wins", "need", "estimate", "low", "high", raw.alias("verdict_raw"), F.when(may, raw).otherwise("SHADOW").alias("verdict"), reason.alias("reason"))


def admission_sequence(oos: DataFrame, statuses: dict[str, str], fresh: bool, draws: int = 4_000) -> DataFrame:
    """Candidates in the fixed order, each beside the production members and those that its series has admitted before it."""
    base = [m for m in MEMBERS if statuses.get(m) in COMBINING]
    d = oos.withColumns({f"in_{m}": F.lit(m in base) for m in MEMBERS})
    out = None
    for m in (m for m in MEMBERS if m not in base and statuses.get(m) not in OUT_OF_BAND):
        test = admission(d, m, None, fresh, draws)
        inside = d.groupBy(SERIES).agg(F.array_join(F.array_compact(F.array(*(F.when(F.first(f"in_{x}"), F.lit(x)) for x in MEMBERS))), ",").alias("beside"))
        test = test.join(inside, SERIES)
        out = test if out is None else out.unionByName(test)
        if fresh:  # an observed record admits none
            d = d.join(test.select(SERIES, (F.col("verdict") == "ADMIT").alias("_now")), SERIES, "left").withColumn(f"in_{m}", F.coalesce("_now", F.lit(False))).drop("_now")
    return out


def admission_due(tiles: DataFrame, last_eval: int | None = None) -> DataFrame:
    """Whether a test is due by the number of complete tiles: at LEAST_BLOCKS first, then after AGAIN more."""
    n = tiles.groupBy(SERIES).agg(F.count_if("complete").alias("n_complete"))
    due = F.col("n_complete") >= LEAST_BLOCKS if last_eval is None else (F.col("n_complete") >= LEAST_BLOCKS) & (F.col("n_complete") - last_eval >= AGAIN)
    nxt = F.when(F.col("n_complete") < LEAST_BLOCKS, F.lit(LEAST_BLOCKS)).otherwise((F.col("n_complete") if last_eval is None else F.lit(last_eval)) + AGAIN)
    return n.select(SERIES, "n_complete", due.alias("due"), nxt.alias("next_at"))


def effective_statuses(members: DataFrame, asof: str) -> DataFrame:
    """members (member, status, effective): an admitted one is in the shadow until its date; one without a date is at fault."""
    late = F.col("effective").isNull() | (F.col("effective") > F.lit(asof).cast("date"))
    admitted = F.col("status") == "admitted"
    return members.withColumns({"fault": admitted & F.col("effective").isNull(), "status": F.when(admitted & late, "shadow").otherwise(F.col("status"))})


def registry(oos: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """Brier score, skill and AUC of each member by series, with its status."""
    cells = F.array(*(F.struct(F.lit(m).alias("member"), F.col(f"m_{m}").alias("p")) for m in MEMBERS))
    rows = oos.select(SERIES, "pos", "y", "clim", F.explode(cells).alias("x")).select(SERIES, "y", "clim", "x.member", "x.p").dropna()
    scores = rows.groupBy(SERIES, "member").agg(F.avg(scoring.loss("p")).alias("brier"), F.avg(scoring.loss("clim")).alias("brier_clim"))
    got = scores.join(scoring.auc(rows, "p", [SERIES, "member"]), [SERIES, "member"])
    status = F.create_map(*(F.lit(x) for kv in statuses.items() for x in kv))
    return got.select(SERIES, "member", "n", "brier", (1 - ratio(F.col("brier"), F.col("brier_clim"))).alias("skill"), "auc", F.try_element_at(status, F.col("member")).alias("status"))


def member_health(scores: DataFrame, trips: DataFrame) -> DataFrame:
    """Members (skill, auc) with the times their guard held back a fit: rejected without skill, with a poor AUC or too many trips."""
    d = scores.join(trips, SERIES, "left").withColumn("trips", F.coalesce("trips", F.lit(0)))
    why = F.when(F.col("skill") <= 0, "no_skill").when(F.col("auc") < 0.60, "auc").when(F.col("trips") >= 3, "guard")
    return d.select(SERIES, "member", "skill", "auc", "trips", why.alias("reason"), F.when(why.isNull(), "shadow").otherwise("candidate_rejected").alias("status"))
