"""Raw feeds as the vendors give them: text lines, JSON points, wide price panels; and versioned folders of frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES

ZONE = "America/New_York"


def split_prices(raw: DataFrame, wanted: list[str], truth: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long raw prices (series_id, date, open, high, low, close) as closes from the truth series' first day on, its bars, and missing series."""
    rows = raw.filter("close is not null").groupBy(SERIES, "date").agg(*(F.max_by(c, F.struct("line")).alias(c) for c in ("open", "high", "low", "close")))
    first = rows.filter(F.col(SERIES) == truth).agg(F.min("date").alias("_first"))
    # one row
    closes = rows.filter(F.col(SERIES).isin(*wanted)).join(F.broadcast(first)).filter(F.col("date") >= F.col("_first")).select(SERIES, "date", "close")
    asked = raw.sparkSession.createDataFrame([(w,) for w in wanted], f"{SERIES} string")
    return closes, rows.filter(F.col(SERIES) == truth), asked.join(rows.select(SERIES).distinct(), SERIES, "left_anti")


def index_csv(lines: DataFrame) -> DataFrame:
    """Values of CSV lines (feed, line_no, text) with a header: its CLOSE column or else its last; dates in two forms.

    Lines whose date or value can't be read fall out; of a date the last line counts.
    """
    cells = F.transform(F.split("text", ","), lambda x: F.trim(x))
    heads = lines.filter("line_no = 0").select("feed", F.transform(cells, F.upper).alias("head"))
    at = F.array_position("head", F.lit("CLOSE"))
    heads = heads.select("feed", F.when(at > 0, at).otherwise(F.size("head")).cast("int").alias("at"))
    rows = lines.filter("line_no > 0").join(heads, "feed").withColumn("cells", cells)
    date = F.coalesce(F.try_to_timestamp(F.get("cells", F.lit(0)), F.lit("MM/dd/yyyy")), F.try_to_timestamp(F.get("cells", F.lit(0)), F.lit("yyyy-MM-dd"))).cast("date")
    value = F.get("cells", F.col("at") - 1).try_cast("double")
    good = rows.select("feed", "line_no", date.alias("date"), value.alias("value")).filter("date is not null and value is not null")
    return good.groupBy("feed", "date").agg(F.max_by("value", "line_no").alias("value"))


def point_date(ms: Column) -> Column:
    """Day of a point in epoch milliseconds: of UTC at its midnight, else of the exchange's zone."""
    t = F.timestamp_millis(ms.cast("long"))
    utc = F.to_utc_timestamp(t, F.current_timezone())
    return F.when(F.date_trunc("day", utc) == utc, F.to_date(utc)).otherwise(F.to_date(F.from_utc_timestamp(utc, ZONE)))


POINTS = "array<struct<x:double,y:double>>"


def points(payloads: DataFrame, column: str) -> DataFrame:
    """name, date, value of arrays of points in JSON (name and the column): malformed ones fall out, of a day the last counts."""
    rows = payloads.select("name", F.posexplode(F.from_json(column, POINTS)).alias("k", "p")).filter("p.x is not null and p.y is not null")
    return rows.groupBy("name", point_date(F.col("p.x")).alias("date")).agg(F.max_by("p.y", "k").alias("value"))


def sentiment(payloads: DataFrame, parts: list[str]) -> DataFrame:
    """One row a date of a nested payload (text): the score and its parts, in a fixed order of columns."""
    inner = F.from_json("text", "struct<" + ",".join(f"{p}:struct<data:{POINTS}>" for p in ("score", *parts)) + ">")
    d = payloads.select(inner.alias("j"))
    long = d.select(F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.to_json(F.col(f"j.{p}.data")).alias("data")) for p in ("score", *parts)))).alias("x")).select("x.name", "x.data")
    return points(long, "data").groupBy("date").pivot("name", ["score", *parts]).agg(F.first("value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frame of CSV by a fixed schema: no column is guessed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles with six places; Spark commits the whole folder or nothing."""
    kinds = dict(df.dtypes)
    df.select(*(F.format_string("%.6f", c).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path)


def save_frames(frames: dict[str, DataFrame], root: str) -> str:
    """All frames under a new version, then a pointer row: a reader sees all of them or none. Returns the version."""
    version, spark = uuid.uuid4().hex, next(iter(frames.values())).sparkSession
    rows = []
    for name, df in frames.items():
        df.write.parquet(f"{root}/{version}/{name}")
        back = spark.read.parquet(f"{root}/{version}/{name}")
        rows.append((name, version, back.count(), str(back.agg(F.max("date")).first()[0]) if "date" in back.columns else None))
    pointer = spark.createDataFrame(rows, "name string, version string, n long, last_date string").withColumn("written", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return version


def load_frames(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The frames of the latest version; ValueError if one has other rows than were written."""
    w = Window.orderBy(F.col("written").desc(), F.col("version"))
    latest = spark.read.parquet(f"{root}/_versions").withColumn("_v", F.dense_rank().over(w)).filter("_v = 1").collect()  # a handful of frames
    out = {r["name"]: spark.read.parquet(f"{root}/{r['version']}/{r['name']}") for r in latest}
    for r in latest:
        if out[r["name"]].count() != r["n"]:
            raise ValueError(f"{r['name']} has other rows than version {r['version']} states")
    return out
