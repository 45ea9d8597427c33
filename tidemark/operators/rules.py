"""The rule engine: metrics to eight signal states, their weighted score, overall states and the decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES

#: Scores of states, weights of signals, the band of overall states.
SCORES = {"GREEN": 1.0, "R2G": 0.5, "AMBER": 0.0, "G2R": -0.5, "RED": -1.0}
WEIGHTS = {"basket": 1.2, "macd": 1.5, "fg": 1.0, "vix": 0.8, "ma": 1.2, "eod": 1.0, "lead": 0.8, "btc": 1.0}
BAND, FALLBACK = 0.45, 0.35
STATES = tuple(SCORES)
TONES = {"buy": 1.0, "hold": 1.0, "neutral": 1.0, "caution": 0.5, "reduce": 0.25}


def pick(*rules: tuple[Column, str], other: str) -> Column:
    """The state of the first rule that holds."""
    out = F.when(*rules[0][:1], rules[0][1])
    for when, state in rules[1:]:
        out = out.when(when, state)
    return out.otherwise(other)


def assess() -> dict[str, Column]:
    """States of the eight signals from the metrics' columns; ``ma`` at or below 0 is below trend."""
    c = F.col
    below = c("ma") <= 0
    side = lambda low, high: F.when(below, low).otherwise(high)
    turn = lambda up, good, bad: F.when(up, good).otherwise(bad)
    fg = F.when(c("fg").isNull(), "AMBER").when(c("fg") <= 10, "R2G").when(c("fg") <= 25, turn(c("fg_chg") > 0, "R2G", "RED")).when(c("fg") >= 75, turn(c("fg_chg") < 0, "G2R", "GREEN")).when(c("fg") >= 55, "GREEN").otherwise("AMBER")
    vix = F.when(c("vix") >= 40, turn(c("vix_chg") <= 0, "R2G", "RED")).when(c("vix") >= 28, "RED").when(c("vix") <= 17, "GREEN").when(~below & (c("vix_chg") >= 4), "G2R").otherwise("AMBER")
    return {
        "basket": side(pick((c("rs") >= 1.5, "R2G"), (c("rs") <= -1.5, "RED"), other="AMBER"), pick((c("rs") <= -2, "G2R"), (c("rs") >= 0, "GREEN"), other="AMBER")),
        "macd": F.when(c("phase") == "down", "RED").when(c("phase") == "turn", "R2G").when(c("phase") == "up", "GREEN").otherwise("G2R"),
        "fg": fg,
        "vix": vix,
        "ma": pick((below, "R2G"), (c("ma") <= 3, "AMBER"), other="GREEN"),
        "eod": side(pick((c("streak") >= 3, "R2G"), (c("streak") == 0, "RED"), other="AMBER"), pick((c("streak") >= 3, "GREEN"), other="AMBER")),
        "lead": side(pick((c("leaders") >= 5, "R2G"), (c("leaders") <= 2, "RED"), other="AMBER"), pick((c("leaders") >= 5, "GREEN"), other="AMBER")),
        "btc": side(pick(((c("btc_mom") > 2) & (c("btc_up") >= 2), "R2G"), other="RED"), pick((c("btc_mom") < -3, "G2R"), (c("btc_mom") > 0, "GREEN"), other="AMBER")),
    }


def score_of(state: Column) -> Column:
    out = F.when(state == "GREEN", 1.0)
    for name, value in SCORES.items():
        out = out.when(state == name, value)
    return out


def composite(df: DataFrame, missing: dict[str, Column] | None = None) -> Column:
    """Weighted mean of the scores of the signals that are there."""
    there = {k: (~missing[k]).cast("double") if missing and k in missing else F.lit(1.0) for k in WEIGHTS}
    top = sum(WEIGHTS[k] * score_of(F.col(f"s_{k}")) * there[k] for k in WEIGHTS)
    return top / sum(WEIGHTS[k] * there[k] for k in WEIGHTS)


def overall(score: Column, trend: Column) -> Column:
    return (
        F.when(score >= BAND, F.when(trend < 0, "G2R").otherwise("GREEN"))
        .when(score <= -BAND, F.when(trend > 0, "R2G").otherwise("RED"))
        .when(trend > 0, "R2G").when(trend < 0, "G2R").otherwise("AMBER")
    )


def combo_rule(m: Column, w: Column, d: Column) -> Column:
    """Number of the first of ten rules that holds for monthly, weekly and daily states; 0 if none."""
    up, down = ("GREEN", "R2G"), ("RED", "G2R")
    return (
        F.when(m.isin(*down) & w.isin(*down) & d.isin(*down), 1)
        .when((d == "R2G") & w.isin(*down) & m.isin(*down), 2)
        .when((w == "R2G") & d.isin(*up) & (m != "GREEN"), 3)
        .when(m.isin("RED", "AMBER", "G2R") & w.isin(*up) & (d == "GREEN"), 4)
        .when((m == "R2G") & (w.isin(*down) | d.isin(*down)), 5)
        .when(m == "R2G", 6)
        .when((m == "GREEN") & ~w.isin(*down) & d.isin("RED", "R2G"), 7)
        .when((m == "GREEN") & (w == "GREEN") & (d == "G2R"), 8)
        .when((m == "GREEN") & w.isin(*down), 9)
        .when((m == "GREEN") & w.isin("GREEN", "AMBER") & d.isin("GREEN", "AMBER"), 10)
        .otherwise(0)
    )


def combo_tone(rule: Column, m: Column, w: Column, d: Column) -> Column:
    mean = (score_of(m) + score_of(w) + score_of(d)) / 3
    return (
        F.when(rule.isin(1, 9), "reduce").when(rule.isin(2, 5, 8), "caution").when(rule.isin(3, 4, 6, 7), "buy").when(rule == 10, "hold")
        .when(mean >= FALLBACK, "hold").when(mean <= -FALLBACK, "reduce").otherwise("neutral")
    )


def decision_table(spark: SparkSession) -> DataFrame:
    """The 125 combinations of monthly, weekly and daily states with rule and tone."""
    s = spark.createDataFrame([(x,) for x in STATES], "s string")
    # three times five rows: the full domain is the point of this product
    grid = s.select(F.col("s").alias("m")).crossJoin(s.select(F.col("s").alias("w"))).crossJoin(s.select(F.col("s").alias("d")))
    return with_tone(grid)


def with_tone(df: DataFrame) -> DataFrame:
    m, w, d = F.col("m"), F.col("w"), F.col("d")
    return df.withColumn("rule", combo_rule(m, w, d)).withColumn("tone", combo_tone(F.col("rule"), m, w, d))


def cell_table(replay: DataFrame) -> DataFrame:
    """Sessions in each of the 125 cells; cells that never occur have none."""
    seen = replay.groupBy("m", "w", "d").agg(F.count("*").alias("n"))
    cells = decision_table(replay.sparkSession).join(seen, ["m", "w", "d"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # 125 rows: their sum is the number of sessions, so the replay runs once
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return cells.select("m", "w", "d", "rule", "tone", "n", (F.col("n") / F.nullif(total, F.lit(0))).alias("share"))


def exposure(tone: Column) -> Column:
    out = F.when(tone == "buy", 1.0)
    for name, weight in TONES.items():
        out = out.when(tone == name, weight)
    return out


def scored(df: DataFrame) -> DataFrame:
    """df of metrics with s_<signal>, score and availability."""
    states = df.withColumns({f"s_{k}": v for k, v in assess().items()})
    return states.withColumn("score", composite(states, {"fg": F.col("fg").isNull()})).select(SERIES, "date", "pos", *(f"s_{k}" for k in WEIGHTS), "score")
