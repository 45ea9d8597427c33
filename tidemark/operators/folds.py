"""Path-dependent operators: an ordered fold over each series, streamed batch by batch.

``fold`` deals series to partitions, sorts them, and runs a step function with a small state; the state crosses batches,
so a task's memory doesn't depend on the length of a series. Each fold can resume from a stored state, and no row reads
what comes after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES, YEAR, trailing

Step = Callable[[dict, tuple], tuple]


def fold(df: DataFrame, inputs: list[str], outputs: str, step: Step, start: dict, by: str = SERIES, order: str = "pos") -> DataFrame:
    """by, order and the outputs of step(state, values of inputs) for each row of df, in the order of each series.

    step changes the state in place; nulls arrive as None. start holds a new series' state.
    """
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, dict(start)
        for frame in frames:
            rows = []
            for k, *values in frame[[by, *inputs]].itertuples(index=False, name=None):
                if k != key:
                    key, state = k, dict(start)
                rows.append(step(state, tuple(None if v is None or v != v else v for v in values)))
            yield pd.concat([frame[[by, order]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kinds = dict(df.dtypes)
    ordered = df.select(by, order, *(c for c in inputs if c not in (by, order))).repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {outputs}")


@dataclass(frozen=True)
class DecisionConfig:
    enter_caution: float = 1.5
    exit_caution: float = 1.2
    enter_reduce: float = 2.5
    exit_reduce: float = 2.0
    dwell: int = 5
    dwell_escalate: int = 0


#: Named settings of the machine.
CONFIGS = {"default": DecisionConfig(), "wide": DecisionConfig(1.75, 1.25, 3.0, 2.25), "symmetric_dwell": DecisionConfig(dwell_escalate=5), "no_dwell": DecisionConfig(dwell=0)}


def decide(r: float | None, state: str, days: int, cfg: DecisionConfig) -> tuple[str, int]:
    """One session of the state machine: up at once, down only after the dwell; without r the state stays."""
    level = {"normal": 0, "caution": 1, "reduce": 2}[state]
    if r is None:
        return state, days + 1
    enter = 2 if r >= cfg.enter_reduce else 1 if r >= cfg.enter_caution else 0
    stay = 2 if r >= cfg.exit_reduce else 1 if r >= cfg.exit_caution else 0
    goal, needed = (enter, cfg.dwell_escalate) if enter > level else (min(level, stay), cfg.dwell)
    if goal != level and days >= needed:
        return ("normal", "caution", "reduce")[goal], 1
    return state, days + 1


def decisions(df: DataFrame, cfg: DecisionConfig | None = None, state: str = "normal", days: int = 0) -> DataFrame:
    """series_id, pos, state, days_in_state, changed and churn of the last 252 sessions; df has r = p / climatology."""
    cfg = cfg or DecisionConfig()

    def step(held: dict, row: tuple) -> tuple:
        before = held["state"]
        held["state"], held["days"] = decide(row[0], before, held["days"], cfg)
        return held["state"], held["days"], before != held["state"]

    out = fold(df, ["r"], "state string, days_in_state long, changed boolean", step, {"state": state, "days": days})
    return out.withColumn("churn_252", F.sum(F.col("changed").cast("long")).over(trailing(YEAR)))


def ewma_vol(df: DataFrame, lam: float = 0.94, seed: int = 60) -> DataFrame:
    """Annualised exponential volatility of returns r, seeded by the sample variance of the first ``seed``; null before."""

    def step(held: dict, row: tuple) -> tuple:
        r = row[0]
        if r is None:
            return (None,)
        if held["v"] is None:
            n = held["n"] = held["n"] + 1
            delta = r - held["mean"]
            held["mean"] += delta / n
            held["m2"] += delta * (r - held["mean"])
            if n < seed:
                return (None,)
            held["v"] = held["m2"] / (n - 1)
        else:
            held["v"] = lam * held["v"] + (1 - lam) * r * r
        return ((held["v"] * YEAR) ** 0.5,)

    return fold(df, ["r"], "sigma double", step, {"v": None, "n": 0, "mean": 0.0, "m2": 0.0})


def on_grid(target: float, grid: float) -> float:
    """The nearest weight of the grid, to ten places: 7 * 0.05 is 0.35."""
    return round(round(target / grid) * grid, 10)


def sizing(df: DataFrame, grid: float = 0.05, band: float = 0.10, w: float | None = None, mult: float | None = None, deploy: bool = True, escalate: bool = True, by: str = SERIES) -> DataFrame:
    """Executed weights from w_target, mult and week_end: hold without input, init, cut at once, else weekly beyond the band.

    The band is compared in plain doubles, without tolerance. ``w`` and ``mult`` resume a path.
    """

    def step(held: dict, row: tuple) -> tuple:
        target, m, week_end = row
        w, m_before = held["w"], held["m"]
        if not deploy:
            why = "info_only"
        elif target is None or m is None:
            why = "input_missing"
        else:
            goal = on_grid(target, grid)
            if w is None:
                w, why = goal, "init"
            elif escalate and m_before is not None and m < m_before:
                w, why = min(goal, w), "escalation"
            elif week_end and abs(target - w) >= band:
                w, why = goal, "weekly"
            else:
                why = "hold"
        if w is not None:
            held["w"] = w
        if m is not None:
            held["m"] = m
        return w, why

    return fold(df, ["w_target", "mult", "week_end"], "w_exec double, reason string", step, {"w": w, "m": mult}, by)


def sizing_rules(rows: DataFrame) -> DataFrame:
    """The same step where grid, band, check and at_once are columns: rows of many rules, one path each."""

    def step(held: dict, row: tuple) -> tuple:
        target, m, grid, band, check, at_once = row
        w, before = held["w"], held["m"]
        if target is None or m is None:
            why = "input_missing"
        else:
            goal = on_grid(target, grid)
            if w is None:
                w, why = goal, "init"
            elif at_once and before is not None and m < before:
                w, why = min(goal, w), "escalation"
            elif check and abs(target - w) >= band:
                w, why = goal, "weekly"
            else:
                why = "hold"
        held["w"] = w
        held["m"] = m if m is not None else before
        return w, why

    return fold(rows, ["w_target", "mult", "grid", "band", "check", "at_once"], "w_exec double, reason string", step, {"w": None, "m": None}, "path")


@dataclass(frozen=True)
class Regimes:
    """A two-state Gaussian model: stay probabilities, means and variances of one observation; state 1 is the volatile."""

    p00: float
    p11: float
    mean0: float
    mean1: float
    var0: float
    var1: float


def regime_filter(df: DataFrame, theta: Regimes, p_high: float | None = None) -> DataFrame:
    """Probability of the volatile state given all observations x up to a row; a missing one only predicts, and gives null."""
    from math import exp, sqrt

    def density(x: float, mean: float, var: float) -> float:
        return exp(-((x - mean) ** 2) / (2 * var)) / sqrt(var)

    def step(held: dict, row: tuple) -> tuple:
        high = held["p"] * theta.p11 + (1 - held["p"]) * (1 - theta.p00)
        if row[0] is None:
            held["p"] = high
            return (None,)
        a, b = high * density(row[0], theta.mean1, theta.var1), (1 - high) * density(row[0], theta.mean0, theta.var0)
        held["p"] = a / (a + b) if a + b > 0 else high
        return (held["p"],)

    stationary = (1 - theta.p00) / (2 - theta.p00 - theta.p11)
    return fold(df, ["x"], "p_high double", step, {"p": stationary if p_high is None else p_high})


def greedy_blocks(df: DataFrame, h: int = 20) -> DataFrame:
    """Whether a row opens a block: the first of a series, and then each at least h places after the last opening."""

    def step(held: dict, row: tuple) -> tuple:
        opens = held["at"] is None or row[0] - held["at"] >= h
        if opens:
            held["at"] = row[0]
        return (bool(opens),)

    return fold(df.withColumn("place", F.col("pos")), ["place"], "opens boolean", step, {"at": None})


def macd_phase(df: DataFrame, confirm: int = 3, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD of closes: histogram, run of rises or falls, and phase: up or down, or turn and roll on confirmed reversals."""
    a, b, c = (2 / (k + 1) for k in (fast, slow, signal))

    def step(held: dict, row: tuple) -> tuple:
        x = row[0]
        first = held["f"] is None
        held["f"] = x if first else held["f"] + a * (x - held["f"])
        held["s"] = x if first else held["s"] + b * (x - held["s"])
        macd = held["f"] - held["s"]
        held["g"] = macd if first else held["g"] + c * (macd - held["g"])
        hist = macd - held["g"]
        move = 0 if held["h"] is None else (hist > held["h"]) - (hist < held["h"])
        held["run"] = held["run"] + move if move and held["run"] * move > 0 else move
        held["h"] = hist
        if hist < 0:
            phase = "turn" if held["run"] >= confirm else "down"
        else:
            phase = "roll" if hist > 0 and held["run"] <= -confirm else "up"
        return hist, held["run"], phase

    return fold(df, ["close"], "hist double, run long, phase string", step, {"f": None, "s": None, "g": None, "h": None, "run": 0})
