"""Operator 11: documents resampled towards a target distribution by importance weights over hashed word runs.

A document's features are its runs of one to three words, hashed into buckets. The gain of a bucket is the logarithm of
how much more frequent it is in the target texts than in all documents; a document's weight is the sum over its features.
The weight and a Gumbel draw seeded by the document's id make its score, and the highest scores are taken: a sample
without replacement in proportion to the importance weights.

Scores come from an array of gains, task by task. The place of the cut is found by radix selection: the keys (score, then
doc_id, then the number of features, then the row's place in the stored table) are compared digit by digit, each digit by
one count over the rows that still agree with the cut, until the bucket of a digit is taken whole. Only the rows above
the cut are range-sorted and ranked; all others get no rank.

What is sent to all tasks: the BUCKETS gains (80 KB). What the driver collects: one array of BUCKETS counters for each
slice (of counters that were summed before), at most 2 ^ DIGIT_BITS counts a digit, one count for each sorted range.

Defined cases: a null or empty text has no words, no features and the weight 0, and is not among the documents that can
be drawn; a null doc_id is seeded as the empty text and comes last among equal scores; of rows equal in id and score that
with fewer features comes first, and rows equal in all of these are exchangeable, so that reruns give the same rows; very
long texts are taken in blocks; an empty table gives an empty table, and without target texts all t are 0; other
columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

BUCKETS, LONGEST_RUN = 10_000, 3
SEED, LEAST_WORDS, PERCENT, SCALE = 42, 20, 5, 1000
#: Bits of a digit of the radix selection.
DIGIT_BITS = 12
#: Bytes of text that are split into words at once.
BLOCK = 1 << 20

#: A-Z to lower case, all other ASCII but digits and letters to spaces; bytes beyond ASCII are parts of words.
AS_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def feature_buckets(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each block of a text; a run's CRC goes on from the shorter run's."""
    raw = (text or "").encode().translate(AS_WORDS)
    at, before = 0, []  # before: the last words of the block before
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK) if len(raw) - at > BLOCK else len(raw)
        end = len(raw) if end < 0 else end
        new = raw[at:end].split()
        at = end
        if not new:
            continue
        words, old = before + new, len(before)
        spaced = [b" " + w for w in words]
        crcs = list(map(crc32, words))
        found = crcs[old:]
        for k in range(1, LONGEST_RUN):
            crcs = list(map(crc32, spaced[k:], crcs))
            found += crcs[max(0, old - k) :]
        before = words[-(LONGEST_RUN - 1) :]
        yield len(new), np.fromiter(found, np.uint32, len(found)) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket, over all texts (one column). Each task sends one array, in slices that are summed apart."""
    size = 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, of in feature_buckets(text.as_py()):
                    total += np.bincount(of, minlength=BUCKETS)
        full = [k for k in range(0, BUCKETS, size) if total[k : k + size].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(full, pa.int64()), "counts": pa.array([total[k : k + size].tolist() for k in full], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(count, "slice long, counts array<long>")
    by_bucket = counted.select("slice", F.posexplode("counts").alias("i", "n")).groupBy((F.col("slice") + F.col("i")).alias("bucket")).agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in by_bucket.collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))) of each bucket."""
    total, target = float(all_counts.sum() + BUCKETS), float(target_counts.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * total / ((s + 1.0) * target))) for s, t in zip(all_counts.tolist(), target_counts.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                parts = [(n, len(of), int(gain[of].sum())) for n, of in feature_buckets(text.as_py())]
                rows.append(tuple(map(sum, zip(*parts, strict=True))) if parts else (0, 0, 0))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-SCALE * ln(-ln((h + 0.5) / 2^32))), h from the SHA-256 of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: Parts of the key in their order: whether larger comes first.
KEY = {"score": True, "nameless": False, "id_high": False, "id_low": False, "n_features": False, "row": False}


def cut(rows: DataFrame, k: int) -> Column:
    """The condition that exactly the first k of rows meet, by the key. rows: the columns of KEY, of a stored table.

    Each digit costs one pass that counts; what lies before the digit's bucket is taken, and the bucket is searched on.
    """
    taken, agree = [], F.lit(True)
    for name, falling in KEY.items():
        value = F.col(name)
        low, high = rows.filter(agree).agg(F.min(value), F.max(value)).first()
        if low is None or low == high:  # the part says nothing here (a null id is told by ``nameless``)
            continue
        place = (F.lit(high) - value) if falling else (value - F.lit(low))
        bits = int(high - low).bit_length()
        while bits > 0:
            bits = max(0, bits - DIGIT_BITS)
            digit = F.shiftright(place, bits)
            counts = sorted(rows.filter(agree).groupBy(digit.alias("digit")).count().collect())
            for at, n in counts:
                if n >= k:
                    break
                k -= n
            taken.append(agree & (digit < at))
            agree &= digit == at
            if n == k:
                return reduce(lambda a, b: a | b, [*taken, agree])
    return reduce(lambda a, b: a | b, [*taken, agree])


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank (1, 2, ...) by the key: ranges are sorted apart, and each goes on where the ranges before it end."""
    order = [F.col(name).desc_nulls_last() if falling else F.col(name).asc_nulls_last() for name, falling in KEY.items()]
    inside = F.monotonically_increasing_id()
    ranges = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", inside))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    starts, n = [], 0
    for p, count in sorted(ranges.groupBy(part.alias("part")).count().collect()):  # one row a range
        starts.append((p, n))
        n += count
    heads = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return ranges.withColumn("part", part).join(F.broadcast(heads), "part").withColumn("rank", F.col("start") + place + 1).drop("part", "start", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text), drawn towards target (text)."""
    gain = gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text")))
    score = F.col("weight") + drawn(F.col("doc_id"), seed)
    halves = {"id_high": F.shiftright("doc_id", 32), "id_low": F.col("doc_id").bitwiseAND((1 << 32) - 1), "nameless": F.col("doc_id").isNull().cast("long")}
    scored = checkpointed(weighted(docs, gain).withColumns({"score": score, "row": F.monotonically_increasing_id(), **halves}))
    may = F.col("n_words") >= least_words
    k = percent * scored.filter(may).count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(out)
    first = may & cut(scored.filter(may), k)
    rest = scored.filter(~F.coalesce(first, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.filter(first)).select(out).unionByName(rest.select(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
