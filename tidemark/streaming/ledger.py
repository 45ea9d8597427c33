"""The live ledger as a stream: ticks to closed bars, a row for each, and its outcomes 20 and 60 bars later.

State is keyed by series. A timer closes a bar when the watermark has passed its end; a closed bar is a ledger row, and
completes the rows that wait for it: the bar 20 or 60 before gets its return and its deepest fall, once. The sink writes
each micro-batch to a folder of its own, so a batch that is run again after a failure replaces itself and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.expr import SERIES

HORIZONS = (20, 60)
ROWS = f"{SERIES} string, horizon long, bar timestamp, known_at timestamp, close double, fwd_ret double, fwd_maxdd double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ledger(StatefulProcessor):
    """Open bars by their begin, and the closes of the last bars: as many as the longest horizon looks back."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bar long", "ts long, close double")
        self.closed = handle.getValueState("closed", "bars array<bigint>, closes array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last: dict[int, tuple[int, float]] = {}
        for frame in rows:
            stamps = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            for ts, value in zip(stamps.tolist(), frame["value"].tolist(), strict=True):
                bar = ts // 1_000_000 // self.seconds * self.seconds
                if bar not in last or ts >= last[bar][0]:
                    last[bar] = (ts, float(value))
        for bar, (ts, close) in last.items():
            if not self.open.containsKey((bar,)):
                self.handle.registerTimer((bar + self.seconds) * 1000)
            elif self.open.getValue((bar,))[0] > ts:
                continue
            self.open.updateValue((bar,), (ts, close))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bar = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds
        _, close = self.open.getValue((bar,))
        self.open.removeKey((bar,))
        bars, closes = (list(x) for x in self.closed.get()) if self.closed.exists() else ([], [])
        bars, closes = [*bars, bar][-HORIZONS[-1] - 1 :], [*closes, close][-HORIZONS[-1] - 1 :]
        self.closed.update((bars, closes))
        stamp = lambda s: pd.Timestamp(s, unit="s", tz="UTC")
        out = [(key[0], 0, stamp(bar), stamp(bar + self.seconds), close, None, None)]
        for h in HORIZONS:
            if len(bars) > h:
                then = closes[-h - 1]
                out.append((key[0], h, stamp(bars[-h - 1]), stamp(bar + self.seconds), then, close / then - 1, min(0.0, min(closes[-h:]) / then - 1)))
        frame = pd.DataFrame(out, columns=[SERIES, "horizon", "bar", "known_at", "close", "fwd_ret", "fwd_maxdd"])
        yield frame.astype({"fwd_ret": "float64", "fwd_maxdd": "float64"})

    def close(self) -> None:
        pass


def rows_of(ticks: DataFrame, seconds: int = 3600, late: str = "5 minutes") -> DataFrame:
    """Ledger rows (horizon 0: the bar itself) of a stream of ticks (series_id, ts, value)."""
    keyed = ticks.withWatermark("ts", late).groupBy(SERIES)
    return keyed.transformWithStateInPandas(Ledger(seconds), ROWS, "Append", "EventTime")


def run(spark: SparkSession, ticks: DataFrame, folder: str, seconds: int = 3600, late: str = "5 minutes") -> None:
    """Takes what is available into folder/rows and stops; called again, it goes on where it stopped."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need it
    try:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

        query = rows_of(ticks, seconds, late).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/rows").select(*(c.split()[0] for c in ROWS.split(", ")))


def batch(ticks: DataFrame, seconds: int = 3600, late_seconds: int = 300) -> DataFrame:
    """The same rows from a table: bars that the last watermark has passed."""
    from pyspark.sql import Window

    begin = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    bars = ticks.select(SERIES, begin.alias("bar"), "ts", "value").groupBy(SERIES, "bar").agg(F.max_by("value", "ts").cast("double").alias("close"))
    mark = ticks.agg((F.unix_timestamp(F.max("ts")) - late_seconds).alias("mark"))
    end = lambda c: F.timestamp_seconds(F.unix_timestamp(c) + seconds)
    bars = bars.join(F.broadcast(mark), F.unix_timestamp(end("bar")) <= F.col("mark")).drop("mark")  # one row
    w = Window.partitionBy(SERIES).orderBy("bar")
    each = [F.struct(F.lit(0).cast("long").alias("horizon"), end("bar").alias("known_at"), F.lit(None).cast("double").alias("fwd_ret"), F.lit(None).cast("double").alias("fwd_maxdd"))]
    d = bars
    for h in HORIZONS:
        d = d.withColumns({f"at{h}": F.lead("bar", h).over(w), f"c{h}": F.lead("close", h).over(w), f"m{h}": F.min("close").over(w.rowsBetween(1, h))})
        each.append(F.struct(F.lit(h).cast("long").alias("horizon"), end(f"at{h}").alias("known_at"), (F.col(f"c{h}") / F.col("close") - 1).alias("fwd_ret"), F.least(F.lit(0.0), F.col(f"m{h}") / F.col("close") - 1).alias("fwd_maxdd")))
    return d.select(SERIES, "bar", "close", F.explode(F.array(*each)).alias("x")).filter("x.known_at is not null").select(SERIES, "x.horizon", "bar", "x.known_at", "close", "x.fwd_ret", "x.fwd_maxdd")
