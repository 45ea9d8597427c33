"""What the operators of this folder share: reading, the shared folder, words, row-at-a-time Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of anything but the space and the five control characters that count as white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Rows that go to Python at once. Texts may be long: Spark's usual 10,000 rows of a megabyte wouldn't fit a worker.
ROWS_AT_ONCE = 256
#: Rows of a batch that are Python objects at once.
LOT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_shared_folder(spark: SparkSession) -> None:
    """Make ``checkpoint()`` work: the cluster names the folder; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: a lost executor doesn't recompute what is below."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """Words of a text in order; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def gives_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; afterwards the task's freed memory goes back to the system.

    A Python worker is used again by later tasks and shares the executor's memory with the JVM: what a stage has freed but
    kept would be missing in the next.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Each row of df through a function, batch by batch.

    start() runs once in each task and returns the function, which gets the values of the row's columns and returns
    those of the new row. Only the columns of df reach Python, so select before.
    """
    out = StructType.fromDDL(schema)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            rows, held = [], 0
            lots = (batch.slice(i, LOT) for i in range(0, batch.num_rows, LOT))
            for row in (row for lot in lots for row in zip(*(c.to_pylist() for c in lot.columns), strict=True)):
                rows.append(got := f(*row))
                held += sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in got if isinstance(x, str | bytes | list | np.ndarray))
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return df.mapInArrow(lambda batches: gives_back(run(batches)), out)

