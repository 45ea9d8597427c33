"""Operator 5: language identification by sparse multinomial logistic regression.

Features are character n-grams of one to GRAM letters, hashed into 2 ** FEATURE_BITS numbers, as TF-IDF vectors of unit
length. Document frequencies are counted over all documents to learn from. The weights are fitted on a bounded sample,
at most PER_LANGUAGE documents of a language, drawn by a hash of the id, of which the first by that hash are taken until
they hold SAMPLE documents or CELLS features: FTRL-proximal with an elastic net (L1 keeps weights that matter, L2 keeps
them small), then one temperature for all logits that minimises the loss on every fifth document of the sample, which
the fit doesn't see. Every document is scored, whole.

Every language that occurs is learnt. A model has at most WEIGHTS weights: where more than 200 languages occur, features
are folded into fewer numbers, so that memory doesn't grow with the languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, as are all if there is nothing to learn
from; rows without an id or language aren't learnt from; very long texts are counted whole, block by block; equally
likely languages go to the first by name; repeated rows give equal results; an empty table gives an empty table; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, table
from .hashing import counted, mix

GRAM, FEATURE_BITS = 3, 15
PER_LANGUAGE, SAMPLE, CELLS = 500, 20_000, 16_000_000
#: Weights of a model: 26 MB of 4 bytes.
WEIGHTS = 200 << FEATURE_BITS
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.001
CALIBRATE_EVERY = 5
BLOCK = 1 << 17
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _feature(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + np.uint64(n)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def counts_of(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None without a letter. Runs of other characters count as one space."""
    total, any_letter, after_letter, tail = np.zeros(1 << FEATURE_BITS, np.int64), False, False, np.array([32], np.uint64)
    total[_feature(tail + np.uint64(1), 1)] += 1
    text = (text or "").lower()
    for i in range(0, len(text), BLOCK):
        a = np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[np.minimum(a, 0x10FFFF)]
        any_letter = any_letter or bool(letter.any())
        kept = letter | np.concatenate(([after_letter], letter[:-1]))
        after_letter = bool(letter[-1])
        a = np.concatenate((tail, np.where(letter, a, np.uint32(32))[kept].astype(np.uint64)))
        h = np.zeros(len(a), np.uint64)
        for n in range(1, min(GRAM, len(a)) + 1):
            h = h[: len(a) - n + 1] * np.uint64(0x100000001B3) + a[n - 1 :] + np.uint64(1)
            total += np.bincount(_feature(h[max(0, len(tail) - n + 1) :], n), minlength=1 << FEATURE_BITS)  # those that end in this block
        tail = a[-(GRAM - 1) :]
    return total if any_letter else None


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and TF-IDF values of unit length; None without a letter."""
    counts = counts_of(text)
    if counts is None:
        return None
    found = np.flatnonzero(counts)
    values = counts[found] * idf[found]
    return found, values / np.sqrt((values * values).sum())


def folded(x: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A vector with its features folded into n numbers; as it is where it has no more."""
    if n >= 1 << FEATURE_BITS:
        return x
    sums = np.bincount(x[0] % n, x[1], n)
    found = np.flatnonzero(sums)
    return found, sums[found]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_labels: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader, a row for each feature and a last one for the bias."""
    n = min(1 << FEATURE_BITS, max(1, WEIGHTS // n_labels))
    rows = [folded(x, n) for x in rows]
    z = np.zeros((n + 1, n_labels))
    squares = np.zeros_like(z)
    rng = np.random.default_rng(5)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return -np.sign(zs) * np.maximum(np.abs(zs) - L1, 0) / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            found, values = rows[k]
            at, x = np.append(found, len(z) - 1), np.append(values, 1.0)
            zs, ns = z[at], squares[at]
            w = weights(zs, ns)
            miss = softmax(x @ w)
            miss[labels[k]] -= 1
            g = x[:, None] * miss
            new = ns + g * g
            z[at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
            squares[at] = new
    return weights(z, squares)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to divide logits by for the least loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, idf, weights and temperature; its size is bounded by the numbers of features and languages."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights.astype(np.float32), heat

    def logits(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        found, values = folded(x, len(self.weights) - 1)
        return values @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text, self.idf) if self.languages else None
        if x is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(x) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _present(text: str | None) -> np.ndarray:
    counts = counts_of(text)
    return np.zeros(0, np.int64) if counts is None else np.flatnonzero(counts)


def train(docs: DataFrame) -> Model:
    """A model from docs (doc_id, text, lang)."""
    docs = docs.filter("doc_id is not null and lang is not null")
    counts, n = counted(docs.select("text"), 1 << FEATURE_BITS, lambda: _present)
    idf = np.log((n + 1) / (counts.astype(np.float64) + 1)) + 1
    sizes = checkpointed(docs.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # the model needs their names
    if not languages:
        return Model([], idf, np.zeros((1, 0)), 1.0)
    each = max(2, min(PER_LANGUAGE, SAMPLE // len(languages)))
    # the hash of an id is below its language's cut for about twice as many rows as are wanted: the window sees no more
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    cut = F.least(F.lit(1.0), (2.0 * each + 50) / F.col("n")) * float(1 << 63)
    drawn = Window.partitionBy("lang").orderBy(place, "doc_id")
    near = docs.select("doc_id", "lang").join(sizes, "lang").filter(place <= cut)
    chosen = near.select("doc_id", "lang", F.row_number().over(drawn).alias("place")).filter(F.col("place") <= each)
    # at most SAMPLE rows of three short columns, or two for each language
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "place", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = vector(text, idf)
                if x is not None:
                    out.append((lang, place, x[0].astype(np.uint16).tobytes(), x[1].astype(np.float32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "place", "found", "value"])

    drawn_rows = checkpointed(sampled.mapInArrow(vectors, "lang string, place long, found binary, value binary"))
    sums = drawn_rows.groupBy("place").agg(F.sum(F.length("found") / 2).alias("cells")).orderBy("place").collect()  # at most PER_LANGUAGE
    last = max((r["place"] for r, total in zip(sums, accumulate(r["cells"] for r in sums), strict=True) if r["place"] <= 2 or total <= CELLS), default=0)
    got = drawn_rows.filter(F.col("place") <= last).collect()
    got.sort(key=lambda r: (r["place"], r["lang"], r["found"]))
    rows = [(np.frombuffer(r["found"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in got]
    number = {lang: i for i, lang in enumerate(languages)}
    labels = [number[r["lang"]] for r in got]
    held = [r["place"] % CALIBRATE_EVERY == 0 for r in got]
    pick = lambda xs, want: [x for x, h in zip(xs, held, strict=True) if h == want]
    model = Model(languages, idf, fit(pick(rows, False), pick(labels, False), len(languages)), 1.0)
    checks = pick(rows, True)
    if checks:
        model.heat = temperature(np.array([model.logits(x) for x in checks], np.float64), np.array(pick(labels, True)))
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score."""
    held, kinds = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Callable[[str | None], tuple[str, float]] = held.value.predict
        for batch in batches:
            got = [of(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(text, *keep).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string", "score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    model = train(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])
