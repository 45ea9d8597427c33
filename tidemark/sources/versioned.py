"""A table in versions: a change rewrites the months that it touches, and one new file makes it the current state.

Rows lie in folders by month and version. A manifest lists every month with the folder that holds it and what is in it;
a version is a file in ``log`` named by its number, which says which manifest it means. That file is created only if no
other writer has created it, so of two writers one commits and the other is told; a reader sees one version or the next,
never a part. Nothing that a version names is ever changed, so a job that reads it may go on while the next is written.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import SERIES
from tidemark.operators import store

MANIFEST = "month string, at string, version long, n long, last_date date, truth_date date"


class Taken(RuntimeError):
    """Another writer has committed this version first."""


def _files(spark: SparkSession, root: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path  # noqa: SLF001


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number of the latest version and its manifest; (0, None) if there is none."""
    fs, path = _files(spark, root)
    if not fs.exists(path(f"{root}/log")):
        return 0, None
    number = max((int(s.getPath().getName()) for s in fs.listStatus(path(f"{root}/log"))), default=0)
    return (number, spark.read.text(f"{root}/log/{number:012d}").first()[0]) if number else (0, None)


def commit(spark: SparkSession, root: str, number: int, manifest: DataFrame) -> int:
    """Makes a manifest version ``number``; Taken if there is one."""
    name = f"{root}/manifests/{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(name)  # a row a month
    fs, path = _files(spark, root)
    fs.mkdirs(path(f"{root}/log"))
    try:
        out = fs.create(path(f"{root}/log/{number:012d}"), False)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            raise Taken(f"version {number} is there") from e
        raise
    out.write(bytearray(name.encode()))
    out.close()
    return number


def manifest(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """month, at, version, n, last_date, truth_date of the latest version, or of an earlier one."""
    at = current(spark, root)[1] if number is None else spark.read.text(f"{root}/log/{number:012d}").first()[0]
    return spark.read.schema(MANIFEST).parquet(at) if at else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, root: str, number: int | None = None, months: DataFrame | None = None) -> DataFrame:
    """series_id, date, close of a version; only the folders of the months asked for (month) are opened."""
    wanted = manifest(spark, root, number)
    wanted = wanted if months is None else wanted.join(F.broadcast(months), "month", "left_semi")  # a row a month
    folders = [r["at"] for r in wanted.select("at").collect()]
    schema = f"{SERIES} string, date date, close double"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def month(date: str = "date") -> Any:
    return F.date_format(date, "yyyy-MM")


def _written(rows: DataFrame, root: str, number: int, truth: str) -> DataFrame:
    """Manifest rows of the months that rows are written to."""
    at = f"{root}/data/{number:012d}-{uuid.uuid4().hex}"
    # a month's rows may be many: the series spreads them over tasks too
    rows.withColumn("month", month()).repartition("month", SERIES).write.partitionBy("month").parquet(at)
    found = rows.sparkSession.read.schema(f"{SERIES} string, date date, close double, month string").option("basePath", at).parquet(at)
    last_truth = F.max(F.when(F.col(SERIES) == truth, F.col("date")))
    stats = found.groupBy("month").agg(F.count("*").alias("n"), F.max("date").alias("last_date"), last_truth.alias("truth_date"))
    return stats.select("month", F.concat(F.lit(f"{at}/month="), F.col("month")).alias("at"), F.lit(number).cast("long").alias("version"), "n", "last_date", "truth_date")


def build(fetched: DataFrame, root: str, truth: str, always: tuple[str, ...] = (), force: bool = False) -> int:
    """All months anew; refused where a series is lost, shortened or set back, unless forced. Returns the version."""
    spark = fetched.sparkSession
    number, there = current(spark, root)
    rows = store.guard_phantom(fetched.select(SERIES, "date", "close").filter("close is not null"), truth, always)
    if there and not force:
        faults = store.regressions(read(spark, root), rows).select(SERIES, "reason").limit(5).collect()
        if faults:
            raise ValueError(f"the rebuild is refused: {[(r[SERIES], r['reason']) for r in faults]}")
    return commit(spark, root, number + 1, _written(rows, root, number + 1, truth))


def update(fetched: DataFrame, root: str, truth: str, always: tuple[str, ...] = ()) -> int:
    """The latest version with the fetched cells over it: months whose cells don't differ keep their folders."""
    spark = fetched.sparkSession
    number, _ = current(spark, root)
    new = fetched.select(SERIES, "date", "close").filter("close is not null")
    asked = new.select(month().alias("month")).distinct()
    old = read(spark, root, months=asked)
    differ = new.alias("n").join(old.alias("o"), [SERIES, "date"], "left").filter(~F.col("n.close").eqNullSafe(F.col("o.close"))).select(month().alias("month")).distinct()
    had = manifest(spark, root).select(F.max("truth_date").alias("d")).unionByName(new.filter(F.col(SERIES) == truth).select(F.max("date").alias("d")))
    last = had.agg(F.max("d").alias("_truth"))  # one row
    merged = store.upsert_cells(old, new, [SERIES, "date"]).withColumn("month", month()).join(F.broadcast(differ), "month", "left_semi").drop("month")
    kept = merged.join(F.broadcast(last)).filter(F.col(SERIES).isin(*always) | F.col("_truth").isNull() | (F.col("date") <= F.col("_truth"))).drop("_truth")
    changed = _written(kept, root, number + 1, truth)
    rest = manifest(spark, root).join(F.broadcast(differ), "month", "left_anti")
    return commit(spark, root, number + 1, rest.unionByName(changed))
