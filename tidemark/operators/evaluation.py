"""Episodes with splits, warnings held against them, and what shifted warnings would have reached."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, path_key, path_part, series

LOOKBACK, SHIFTS, SEED = 20, 200, 0


def split_episodes(closes: DataFrame, threshold: float) -> DataFrame:
    """Falls of at least ``threshold``, split where a rebound of as much from a trough falls by as much again.

    A trough is confirmed by a rebound of the threshold; a fall by the threshold from the rebound's top then begins
    another episode. All parts of a fall below one high share its recovery, the next strict new high (null if open).
    The rule looks at one day after another, so a task folds over a series' closes, which arrive in order.
    """
    columns = f"{SERIES} string, peak_pos long, trough_pos long, recovery_pos long, depth double"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, {}

        def ended(recovery: int | None) -> list[tuple]:
            rows = [(key, p, t, recovery, d) for p, t, d in s["parts"]]
            s["parts"] = []
            return rows

        def part() -> None:
            (p, high), (t, low) = s["peak"], s["trough"]
            s["parts"].append((p, t, low / high - 1))

        out: list[tuple] = []
        for frame in frames:
            for k, pos, c in frame[[SERIES, "pos", "close"]].itertuples(index=False, name=None):
                if k != key:
                    if s and s["open"]:
                        part()
                        out += ended(None)
                    key, s = k, {"top": (pos, c), "open": False, "parts": []}
                elif c > s["top"][1]:
                    if s["open"]:
                        part()
                        out += ended(pos)
                    s["top"], s["open"] = (pos, c), False
                elif not s["open"]:
                    if c / s["top"][1] - 1 <= -threshold:
                        s["open"], s["peak"], s["trough"], s["rebound"] = True, s["top"], (pos, c), (pos, c)
                elif s["rebound"][1] >= s["trough"][1] * (1 + threshold) and c / s["rebound"][1] - 1 <= -threshold:
                    part()
                    s["peak"], s["trough"], s["rebound"] = s["rebound"], (pos, c), (pos, c)
                elif c < s["trough"][1]:
                    s["trough"] = s["rebound"] = (pos, c)
                elif c > s["rebound"][1]:
                    s["rebound"] = (pos, c)
            yield pd.DataFrame(out, columns=names).astype({"recovery_pos": "Int64"})
            out = []
        if s and s["open"]:
            part()
            yield pd.DataFrame(ended(None), columns=names).astype({"recovery_pos": "Int64"})

    ordered = closes.select(SERIES, F.col("pos").cast("long").alias("pos"), "close").repartition(SERIES).sortWithinPartitions(SERIES, "pos")
    return ordered.mapInPandas(run, columns)


def with_runs(df: DataFrame, flag: str) -> DataFrame:
    """df with run_start and run_end, the places where the run of a true flag that a row is in begins and ends; null elsewhere."""
    before, after = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    starts = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(series()), F.lit(False)), F.col("pos"))
    ends = F.when(F.col(flag) & ~F.coalesce(F.lead(flag).over(series()), F.lit(False)), F.col("pos"))
    d = df.withColumns({"_s": starts, "_e": ends})
    return d.withColumns({"run_start": F.when(F.col(flag), F.max("_s").over(before)), "run_end": F.when(F.col(flag), F.min("_e").over(after))}).drop("_s", "_e")


def warned_episodes(warnings: DataFrame, episodes: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Each episode whose peak lies among the warnings' rows, with its first warning from ``lookback`` before the peak to the trough.

    warnings: pos, warn; each episode lists the places of its window and meets their rows.
    """
    d = with_runs(warnings.select(SERIES, "pos", "warn"), "warn")
    span = d.groupBy(SERIES).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    e = episodes.select(SERIES, "peak_pos", "trough_pos").join(span, SERIES).filter(F.col("peak_pos").between(F.col("first_pos"), F.col("last_pos")))
    e = e.withColumns({"window_start": F.greatest(F.col("peak_pos") - lookback, "first_pos"), "window_end": F.greatest("peak_pos", F.least("trough_pos", "last_pos"))})
    met = e.withColumn("pos", F.explode(F.sequence("window_start", "window_end"))).join(d, [SERIES, "pos"])
    hit = F.when(F.col("warn"), F.struct("pos", "run_start"))
    got = met.groupBy(SERIES, "peak_pos", "trough_pos", "window_start", "window_end").agg(F.min(hit).alias("hit"), F.collect_list(F.when(F.col("warn"), F.col("pos"))).alias("on"))
    warned = F.col("hit.pos")
    length = F.col("window_end") - warned + 1
    return got.select(
        SERIES, "peak_pos", "trough_pos", warned.isNull().alias("missed"), warned.alias("warn_pos"), (F.col("peak_pos") - warned).alias("lead"), F.col("hit.run_start").alias("run_start"),
        F.when(F.col("hit.run_start") <= F.col("peak_pos"), F.col("peak_pos") - F.col("hit.run_start")).alias("age_at_peak"), (F.col("hit.run_start") <= F.col("window_start")).alias("capped"),
        (F.size("on") == length).alias("held"), (F.size("on") / length).alias("share_on"),
    )


def alarm_shares(warnings: DataFrame) -> DataFrame:
    """By series: runs of warnings by the label at their start, false ones a year, and the base rate. warnings: pos, warn, y."""
    d = with_runs(warnings, "warn")
    start = F.col("warn") & (F.col("run_start") == F.col("pos"))
    y = lambda v: F.count_if(start & (F.col("y") == v))
    got = d.groupBy(SERIES).agg(F.count("*").alias("n"), F.count_if(start).alias("runs"), y(1).alias("true_alarms"), y(0).alias("false_alarms"), F.avg("y").alias("base_rate"), F.avg(F.col("warn").cast("double")).alias("warn_share"))
    scored = F.nullif(F.col("true_alarms") + F.col("false_alarms"), F.lit(0))
    return got.select("*", (F.col("true_alarms") / scored).alias("true_share"), (F.col("false_alarms") * YEAR / F.col("n")).alias("false_a_year"))


def evaluation(warnings: DataFrame, episodes: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """One row a series: episodes found, leads, warnings that were on before, alarms and their base rate."""
    e, fresh = warned_episodes(warnings, episodes, lookback), F.when(~F.col("capped"), F.col("lead"))
    got = e.groupBy(SERIES).agg(
        F.count("*").alias("evaluable"), F.count_if(~F.col("missed")).alias("detected"), F.percentile("lead", 0.5).alias("median_lead"), F.avg("lead").alias("mean_lead"), F.count_if(F.col("lead") > 0).alias("before_peak"),
        F.count_if(F.col("capped")).alias("capped"), F.percentile(fresh, 0.5).alias("median_fresh_lead"), F.count_if(F.col("held") & ~F.col("missed")).alias("held"),
    )
    return alarm_shares(warnings).join(got, SERIES, "left")


def shifted_alarms(warnings: DataFrame, episodes: DataFrame, offsets: list[int] | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """Detections, median lead and share of true alarms of the warnings turned round by each offset: the chance level.

    Each series' rows are numbered from 0 and meet the offsets (200 by default, drawn from the number of rows by a seed)
    as places modulo the number of rows; the episodes are then evaluated for each offset as for the warnings themselves.
    """
    n = F.count("*").over(Window.partitionBy(SERIES))
    d = warnings.select(SERIES, "pos", "warn", "y", (F.row_number().over(series()) - 1).alias("i"), n.alias("n"))
    if offsets is None:
        drawn = lambda k: F.pmod(F.xxhash64(F.lit(SEED), F.lit(k)), F.col("n") - 1) + 1
        many = F.array(*(drawn(k) for k in range(SHIFTS)))
    else:
        many = F.array(*map(F.lit, offsets))
    turned = d.select(SERIES, "i", "n", "warn", F.posexplode(many).alias("shift", "offset"))
    turned = turned.select(path_key(SERIES, "shift").alias("path"), SERIES, "shift", F.pmod(F.col("i") + F.col("offset"), F.col("n")).alias("i"), "warn")
    at = turned.join(d.select(SERIES, "i", "pos", "y"), [SERIES, "i"])
    each = at.select(F.col("path").alias(SERIES), F.col(SERIES).alias("of"), "pos", "warn", "y")
    wanted = episodes.select(SERIES, "peak_pos", "trough_pos").join(at.select("path", SERIES).distinct(), SERIES).select(F.col("path").alias(SERIES), "peak_pos", "trough_pos")
    found = evaluation(each, wanted, lookback).withColumn("of", path_part(SERIES, 0))
    rate = F.col("detected") / F.nullif(F.col("evaluable"), F.lit(0))
    q = lambda p: F.percentile("median_lead", p)
    return found.groupBy(F.col("of").alias(SERIES)).agg(
        F.count("*").alias("shifts"), F.avg(rate).alias("detection_mean"), F.avg((rate >= 1).cast("double")).alias("detection_all"), q(0.05).alias("lead_p5"), q(0.5).alias("lead_p50"), q(0.95).alias("lead_p95"), F.avg("true_share").alias("true_share_mean")
    )


def with_warnings(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """pos, warn (any state but normal) and y of each decided session."""
    return decisions.select(SERIES, "pos", (F.col("state") != "normal").alias("warn")).join(labels.select(SERIES, "pos", "y"), [SERIES, "pos"], "left")


def rule_summary(replay: DataFrame, labels: DataFrame) -> DataFrame:
    """The rule in one table: by series and variant, each tone and all of them (``all``), in one pass over grouping sets.

    replay: series_id, variant, pos, date, tone; labels: fwd_ret_20, fwd_ret_60, fwd_maxdd_20, fwd_maxdd_60. A warning
    tone says that the index won't rise; ``baseline`` is what always saying that it will would have hit.
    """
    by = Window.partitionBy(SERIES, "variant")
    up = (~F.col("tone").isin("caution", "reduce")).cast("int")
    d = replay.join(labels.select(SERIES, "pos", "fwd_ret_20", "fwd_ret_60", "fwd_maxdd_20", "fwd_maxdd_60"), [SERIES, "pos"])
    d = d.withColumns({"up": up, "warns": 1.0 - up, "changes": F.coalesce((F.col("tone") != F.lag("tone").over(by.orderBy("pos"))).cast("int"), F.lit(0))})
    rose = lambda h: (F.col(f"fwd_ret_{h}") > 0).cast("int")
    share = lambda c: F.avg(c.cast("double"))
    got = d.groupingSets([[F.col(SERIES), F.col("variant"), F.col("tone")], [F.col(SERIES), F.col("variant")]], SERIES, "variant", "tone").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("fwd_ret_20").alias("realized_20"), share(rose(20) == F.col("up")).alias("hit_20"), share(rose(60) == F.col("up")).alias("hit_60"),
        share(rose(20)).alias("baseline_20"), share(rose(60)).alias("baseline_60"), F.avg("fwd_ret_20").alias("mean_ret_20"), F.percentile("fwd_ret_20", 0.1).alias("ret_p10"), share(F.col("fwd_maxdd_20") <= -0.05).alias("dd5_20"),
        share(F.col("fwd_maxdd_60") <= -0.10).alias("dd10_60"), F.sum("changes").alias("switches"), F.avg("warns").alias("warn_share"),
    )
    days = F.max("n").over(by)
    return got.withColumns({"tone": F.coalesce("tone", F.lit("all")), "share": F.col("n") / days, "brier_clim": F.col("dd5_20") * (1 - F.col("dd5_20")), "switches_a_year": F.col("switches") * YEAR / days})
