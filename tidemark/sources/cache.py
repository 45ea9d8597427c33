"""The cache of prices: what was fetched is checked against what is there, merged, guarded and stored as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES
from tidemark.operators import store
from tidemark.sources import feeds


def build(fetched: DataFrame, root: str, truth: str, always: tuple[str, ...] = (), force: bool = False) -> str:
    """A whole rebuild: refused where a series is lost, shortened or set back against the latest version, unless forced."""
    spark = fetched.sparkSession
    rows = fetched.select(SERIES, "date", "close")
    if not force and _there(spark, root):
        faults = store.regressions(feeds.load_frames(spark, root)["prices"], rows).select(SERIES, "reason").limit(5).collect()
        if faults:
            raise ValueError(f"the rebuild is refused: {[(r[SERIES], r['reason']) for r in faults]}")
    return feeds.save_frames({"prices": store.guard_phantom(rows, truth, always)}, root)


def update(fetched: DataFrame, root: str, truth: str, always: tuple[str, ...] = ()) -> str:
    """The latest version with the fetched cells over it; missing ones keep what is there."""
    old = feeds.load_frames(fetched.sparkSession, root)["prices"]
    merged = store.upsert_cells(old, fetched.select(SERIES, "date", "close"), [SERIES, "date"])
    return feeds.save_frames({"prices": store.guard_phantom(merged.filter("close is not null"), truth, always)}, root)


def _there(spark: SparkSession, root: str) -> bool:
    try:
        return bool(spark.read.parquet(f"{root}/_versions").limit(1).count())
    except Exception as e:  # noqa: BLE001  only the path may be missing
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def spans(df: DataFrame, asof: str, months: int) -> DataFrame:
    """Rows of each series within ``months`` up to a day: the first day is outside."""
    day = F.lit(asof).cast("date")
    return df.filter((F.col("date") > F.add_months(day, -months)) & (F.col("date") <= day))
