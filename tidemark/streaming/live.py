"""Streaming twins of batch operators: closing bars, sliding counts, idempotent appends, resumable decisions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.expr import SERIES
from tidemark.operators.folds import DecisionConfig, decide


def closing_bars(ticks: DataFrame, unit: str = "1 day", late: str = "5 minutes") -> DataFrame:
    """Bars of ticks (series_id, ts, value), each emitted once, when the watermark has passed its end."""
    w = F.window("ts", unit)
    got = ticks.withWatermark("ts", late).groupBy(SERIES, w.alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )
    return got.select(SERIES, F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume")


def first_only(rows: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose keys haven't come within the watermark: an idempotent append."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def decision_stream(rows: DataFrame, cfg: DecisionConfig | None = None) -> DataFrame:
    """The decision machine over a stream of (series_id, pos, r): state and dwell live in keyed state."""
    cfg = cfg or DecisionConfig()

    def step(key: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterable[pd.DataFrame]:
        state, days = held.get if held.exists else ("normal", 0)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, r in rows[["pos", "r"]].itertuples(index=False, name=None):
            state, days = decide(None if r is None or r != r else r, state, days, cfg)
            out.append((key[0], pos, state, days))
        held.update((state, days))
        yield pd.DataFrame(out, columns=[SERIES, "pos", "state", "days_in_state"])

    return rows.groupBy(SERIES).applyInPandasWithState(step, f"{SERIES} string, pos long, state string, days_in_state long", "state string, days long", "append", GroupStateTimeout.NoTimeout)
