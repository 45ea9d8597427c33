"""Operator 9: language-model scores by a hashed maximum-entropy model with class-factored softmax.

A token is a lower-cased word, and each text ends with one end token. log P(token) = log P(class | context) + log
P(slot | class, context) + log P(token | slot). The HOT most frequent tokens fall into classes of about equal shares of
the training tokens, in the order of their frequency, and all others into the last class. Of a class, the most frequent
tokens have slots of their own and the rest share the other slots by their hash; so the first classes hold single tokens
whose probability is a product of two softmaxes. Both softmaxes have features hashed into FEATURES rows of weights: the
previous token, the previous two, the one before the previous (a skip), each for the slots joined with the class; and a
bias, which begins at the shares of the training tokens, so that training begins at the model without context. Within a
slot a token has its share of the slot's tokens, the maximum-entropy solution without context; what no training text
holds shares half a count of its slot, so probabilities sum to one.

Training texts are dealt by a hash of id and text into lots of about LOT_TOKENS tokens, as many as the corpus needs.
Training passes once over all of them, in ROUNDS parts. In each round every lot starts from the same weights and takes
gradient steps over its texts in the order of their hash; the changes of the lots, weighted by their tokens, are averaged
in slices that are summed as a stream in the order of the lots. So reruns agree, whatever the partitions. Token counts
are exact up to collisions of 64-bit hashes. The HOT most frequent tokens go to every task as a table of bounded size; a
text's other tokens find their counts by a shuffled join, so nothing that grows with the vocabulary is broadcast.

Defined cases: a null text has only its end token; a null id counts as the empty text in the fold and forms rows of its
own; rows repeated in id and text each give a row; very long texts are scored whole; tokens of equal counts are ordered
by their hash; without training texts all counts are 0 and V is 0; an empty table gives an empty table; other columns
don't matter.
"""

from __future__ import annotations

import copy
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, use_shared_folder
from .hashing import CELLS, mix, word_hashes

#: Classes, and slots of a class, of which the first OWN hold one token each.
CLASSES, SLOTS, OWN = 32, 32, 20
FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
HOT = 1 << 18
ROUNDS, LOT_TOKENS = 3, 1_000_000
STEP_TOKENS, RATE = 8192, 0.3
#: Tokens that are counted together before counts leave a task, trained together, and scored together.
LOT, TRAINED, SCORED = 2_000_000, 200_000, 150_000
#: The bias of what holds no token.
NEVER = -30.0
#: Exponentials of sums within this bound are single-precision numbers, and so are the sums of a row of them.
SAFE = 80.0
#: Places that have so many rows of gradients that they are added one place after the other.
FEW = 32
END = np.uint64(0x9AE16A3B2F90404F)
_LN10 = math.log(10)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, the end token last."""
    return np.append(word_hashes(b" ".join((text or "").encode().lower().split())), END)


def contexts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token of the texts that begin at starts: previous, previous two, skip."""
    one, two = np.ones(len(h), np.uint64), np.ones(len(h), np.uint64)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[starts] = two[starts] = two[np.minimum(starts + 1, len(h) - 1)] = 1  # a text of one token is followed by a start
    return np.stack([mix(one), mix(one * np.uint64(3) + two), mix(two ^ np.uint64(0x5DEECE66D))])


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def class_rows(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def slot_rows(features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows of features joined with the classes of their tokens."""
    return (mix(features + kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def lowered(x: np.ndarray) -> np.ndarray:
    """x; less the greatest value of each row, if exponentials could leave the range of single precision."""
    if not (x.max() < SAFE and x.min() > -SAFE):
        x -= x.max(1, keepdims=True)
    return x


def sums_by_place(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in at (below 2 ** 16), and for each the sum of its rows of x.

    The first rows of all places are added at once, then the second ones, and so on, places with many rows first; what
    the few most frequent places have left is added place by place.
    """
    order = np.argsort(at.astype(np.uint16), kind="stable")  # sorted by counting
    places = at[order]
    begins = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    fewer = -np.diff(begins, append=len(at))
    by = np.argsort(np.maximum(fewer, -(1 << 15)).astype(np.int16), kind="stable")
    begins, fewer = begins[by], fewer[by]
    sums, k = x.take(order[begins], 0), 1
    while (n := int(np.searchsorted(fewer, -k))) > FEW:
        sums[:n] += x.take(order[begins[:n] + k], 0)
        k += 1
    for i in range(n):
        sums[i] += x.take(order[begins[i] + k : begins[i] - fewer[i]], 0).sum(0)
    return places[begins], sums


def _lots(batches: Iterator[pa.RecordBatch], size: int, by: int | None = None) -> Iterator[tuple[list[np.ndarray], list[tuple]]]:
    """Token arrays and the other columns of texts (first column), about ``size`` tokens at once; rows of one value of column ``by``."""
    found, others, n = [], [], 0
    for batch in batches:
        for text, *other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if by is not None and others and others[-1][by - 1] != other[by - 1]:
                yield found, others
                found, others, n = [], [], 0
            found.append(h := tokens(text))
            others.append(tuple(other))
            n += len(h)
            if n >= size:
                yield found, others
                found, others, n = [], [], 0
    if found:
        yield found, others


def token_counts(docs: DataFrame) -> DataFrame:
    """h, c: how often each token occurs in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _lots(batches, LOT):
            h, c = np.unique(np.concatenate(found), return_counts=True)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def hot_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in ascending order and counts of the most frequent tokens, at most HOT.

    The least count is found from how many tokens have each power of two of it, so tasks send nothing but what is kept.
    Of the level that would be too many, a share by hash is kept.
    """
    level = F.floor(F.log2("c") * 4)
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, n = F.lit(False), 0
    for at, k in levels:
        if n + k > HOT:
            share = max(0.0, (HOT - n - 4 * math.sqrt(HOT - n)) / k)  # that many by hash: at most HOT - n by four deviations
            kept = kept | ((level == int(at)) & (F.shiftrightunsigned(F.xxhash64("h"), 24) < int((1 << 40) * share)))
            break
        kept, n = level >= int(at), n + k
    # a fixed number of short rows, as binary
    rows = counts.filter(kept).coalesce(8).toArrow()
    h, c = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def slot_column(h: Column) -> Column:
    """The slot of a token that isn't hot."""
    return F.shiftrightunsigned(h, 40) % SLOTS


class Layer:
    """A softmax of linear functions: rows of weights for features, a bias row for each condition."""

    def __init__(self, conditions: int, width: int):
        self.weights, self.bias = np.zeros((FEATURES, width), np.float32), np.full((conditions, width), NEVER, np.float32)

    def begin(self) -> None:
        self.squares, self.bias_squares = np.zeros(FEATURES, np.float32), np.zeros(len(self.bias), np.float32)

    def sums(self, rows: np.ndarray, conditions: np.ndarray) -> np.ndarray:
        x = self.weights.take(rows[0], 0)
        x += self.weights.take(rows[1], 0)
        x += self.weights.take(rows[2], 0)
        x += self.bias.take(conditions, 0) if len(self.bias) > 1 else self.bias
        return x

    def logs(self, rows: np.ndarray, conditions: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of what is wanted."""
        x = lowered(self.sums(rows, conditions))
        own = x[np.arange(len(wanted)), wanted]
        np.exp(x, out=x)
        return own - np.log(np.einsum("ij->i", x))

    def step(self, rows: np.ndarray, conditions: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        """One gradient step; the squares of past gradients of a row scale its steps."""
        miss = lowered(self.sums(rows, conditions))
        np.exp(miss, out=miss)
        miss /= np.einsum("ij->i", miss)[:, None]
        miss[np.arange(len(wanted)), wanted] -= 1
        if len(self.bias) == 1:
            g = miss.sum(0)
            self.bias_squares += (g * g).mean()
            self.bias -= rate * g / np.sqrt(self.bias_squares + 1)[:, None]
        parts = [(row, self.weights, self.squares) for row in rows] + [(conditions, self.bias, self.bias_squares)] * (len(self.bias) > 1)
        for at, values, squares in parts:
            own, g = sums_by_place(miss, at)
            own_squares = squares[own] + np.einsum("ij,ij->i", g, g) / g.shape[1]
            squares[own] = own_squares
            g *= (rate / np.sqrt(own_squares + 1))[:, None]
            values[own] = np.subtract(values.take(own, 0), g, out=g)


class Model:
    """Hot tokens with classes, slots and shares; the two layers. Its size is fixed."""

    def __init__(self, hot: np.ndarray, hot_counts: np.ndarray, cold: dict[int, tuple[int, int]] | None = None):
        """cold: counts and numbers of the tokens that aren't hot, by slot."""
        self.hot, self.hot_counts = hot, hot_counts
        order = np.lexsort((hot, -hot_counts))
        before = np.cumsum(hot_counts[order]) - hot_counts[order]
        kind = np.unique(((CLASSES - 1) * before) // max(1, int(hot_counts.sum())), return_inverse=True)[1] if len(hot) else np.zeros(0, np.int64)
        first = np.searchsorted(kind, np.arange(CLASSES))
        place = np.arange(len(hot)) - first[kind]
        own = np.bincount(kind, minlength=CLASSES)[kind] <= SLOTS
        slot = np.where(own | (place < OWN), place, OWN + (hot[order] >> np.uint64(40)).astype(np.int64) % (SLOTS - OWN))
        self.kinds, self.slots = np.empty(len(hot), np.int64), np.empty(len(hot), np.int64)
        self.kinds[order], self.slots[order] = kind, slot
        sums = np.zeros((CLASSES, SLOTS))
        np.add.at(sums, (self.kinds, self.slots), hot_counts)
        self.shares = np.log10(hot_counts / np.maximum(1, sums[self.kinds, self.slots])) if len(hot) else np.zeros(0)
        rest = cold or {}
        self.cold = np.array([math.log10(rest.get(k, (0, 0))[0] + 0.5 * (rest.get(k, (0, 0))[1] + 1)) for k in range(SLOTS)])  # of the last class, by slot
        sums[-1] = [rest.get(k, (0, 0))[0] + 0.5 * (rest.get(k, (0, 0))[1] + 1) for k in range(SLOTS)]
        self.classes, self.members = Layer(1, CLASSES), Layer(CLASSES, SLOTS)
        self.several = (sums > 0).sum(1) > 1  # classes with more than one slot: in others the second factor is 1
        with np.errstate(divide="ignore", invalid="ignore"):
            self.classes.bias[0] = np.maximum(NEVER, np.log(sums.sum(1) / sums.sum()))
            self.members.bias[:] = np.maximum(NEVER, np.nan_to_num(np.log(sums / sums.sum(1, keepdims=True)), nan=0.0, neginf=NEVER))

    def place_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place among the hot tokens, whether there, class and slot of tokens."""
        slot = ((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)
        if not len(self.hot):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.full(len(h), CLASSES - 1), slot
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        hot = self.hot[at] == h
        return at, hot, np.where(hot, self.kinds[at], CLASSES - 1), np.where(hot, self.slots[at], slot)

    def begin(self) -> None:
        self.classes.begin()
        self.members.begin()

    def steps(self, found: list[np.ndarray], rate: float) -> int:
        h = np.concatenate(found)
        features = contexts(h, starts_of(np.array([len(x) for x in found])))
        words, place = np.unique(h, return_inverse=True)
        _, _, kinds, slots = self.place_of(words)
        kinds, slots = kinds[place], slots[place]
        first, none = class_rows(features), np.zeros(len(h), np.int64)
        for i in range(0, len(h), STEP_TOKENS):
            at = slice(i, i + STEP_TOKENS)
            self.classes.step(first[:, at], none[at], kinds[at], rate)
        inside = np.flatnonzero(self.several[kinds])
        kinds, slots = kinds[inside], slots[inside]
        second = slot_rows(features[:, inside], kinds)
        for i in range(0, len(inside), STEP_TOKENS):
            at = slice(i, i + STEP_TOKENS)
            self.members.step(second[:, at], kinds[at], slots[at], rate)
        return len(h)

    def chosen(self, features: np.ndarray, kinds: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each token's class and slot."""
        out = np.empty(len(kinds))
        for i in range(0, len(kinds), 1 << 14):
            at = slice(i, i + (1 << 14))
            out[at] = self.classes.logs(class_rows(features[:, at]), np.zeros(len(kinds[at]), np.int64), kinds[at])
        inside = np.flatnonzero(self.several[kinds])
        kinds, slots = kinds[inside], slots[inside]
        for i in range(0, len(inside), 1 << 14):
            at = slice(i, i + (1 << 14))
            out[inside[at]] += self.members.logs(slot_rows(features[:, inside[at]], kinds[at]), kinds[at], slots[at])
        return out

    def parts(self) -> list[np.ndarray]:
        return [x for layer in (self.classes, self.members) for x in (layer.weights, layer.bias)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parts():
            x[:] = flat[at : at + x.size].reshape(x.shape)
            at += x.size


def round_of_training(docs: DataFrame, model: Model, rate: float, n_lots: int) -> None:
    """The mean of the changes that the n_lots lots of docs (text, lot, order) make, by their tokens."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights and of hot tokens
    schema = "slice long, lot long, n long, part binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own = held.value.flat(), copy.deepcopy(held.value)
        lot, n = None, 0

        def change() -> Iterator[pa.RecordBatch]:
            flat = (own.flat() - start) * np.float32(n)
            yield row(-1, b"")
            for i in range(0, len(flat), CELLS):
                if flat[i : i + CELLS].any():
                    yield row(i // CELLS, flat[i : i + CELLS].tobytes())

        def row(k: int, part: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([lot], pa.int64()), pa.array([n], pa.int64()), pa.array([part], pa.binary())], names)

        for found, others in _lots(batches, TRAINED, 1):
            if others[0][0] != lot:
                if n:
                    yield from change()
                lot, n = others[0][0], 0
                own.take(start)
                own.begin()
            n += own.steps(found, rate)
        if n:
            yield from change()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n_all = 0
        for batch in batches:
            for k, _, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k < 0:
                    n_all += n
                    continue
                part = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        if n_all:
            sums[-1] = np.zeros(0)
        if sums:
            m = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([0] * m, pa.int64()), pa.array([n_all] * m, pa.int64()), pa.array([x.tobytes() for x in sums.values()])], names)

    # by ranges, not by hash: each lot is a task's whole work, so two of them should not meet in one
    dealt = docs.select("text", "lot", "order").repartitionByRange(max(1, n_lots), "lot").sortWithinPartitions("lot", "order").select("text", "lot")
    got = dealt.mapInArrow(run, schema).repartition(16, "slice").sortWithinPartitions("slice", "lot").mapInArrow(summed, schema).collect()
    n_all = sum(r["n"] for r in got if r["slice"] < 0)
    if n_all:
        flat = model.flat()
        for r in got:
            if r["slice"] >= 0:
                part = np.frombuffer(r["part"], np.float64)
                flat[r["slice"] * CELLS : r["slice"] * CELLS + len(part)] += (part / n_all).astype(np.float32)
        model.take(flat)
    held.destroy()


def scored(docs: DataFrame, model: Model, counts: DataFrame, total: int, distinct: int) -> DataFrame:
    """Rows of docs (doc_id, text, held_out) with n_tokens, n_known, base_score, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = math.log10(total + 0.5 * (distinct + 1))
    parts = "doc_id long, held_out boolean, text_hash long, h long, k long, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for found, others in _lots(batches, SCORED):
            h = np.concatenate(found)
            sizes = np.array([len(x) for x in found])
            row = np.repeat(np.arange(len(found)), sizes)
            starts = starts_of(sizes)
            words, place = np.unique(h, return_inverse=True)
            at, hot, kind, slot = model.place_of(words)
            value, plain = np.zeros(len(words)), -model.cold[slot]
            value[hot], plain[hot] = np.log10(model.hot_counts[at[hot]] + 0.5), model.shares[at[hot]]
            chosen = model.chosen(contexts(h, starts), kind[place], slot[place])
            sums = lambda x: np.add.reduceat(x, starts)
            ids, outs, hashes = [o[0] for o in others], [o[1] for o in others], np.array([o[2] for o in others], np.int64)
            known = sums(hot[place].astype(np.int64))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(hashes), pa.array(mix(np.arange(n, dtype=np.uint64) + hashes.view(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(sizes), pa.array(known), pa.array(sums(value[place]) - sizes * base), pa.array(sums(plain[place]) + sums(chosen) / _LN10)],
                names,
            )
            cold = ~hot[place]
            pair, k = np.unique(row[cold] * len(words) + place[cold], return_counts=True)
            r, w = pair // len(words), pair % len(words)
            id_column, out_column = pa.array(ids, pa.int64()), pa.array(outs, pa.bool_())
            for i in range(0, len(r), 50_000):
                own = pa.array(r[i : i + 50_000])
                m = len(own)
                zero, none = pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m))
                yield pa.RecordBatch.from_arrays([id_column.take(own), out_column.take(own), pa.array(hashes[r[i : i + 50_000]]), pa.array(words[w[i : i + 50_000]].view(np.int64)), pa.array(k[i : i + 50_000]), zero, zero, none, none], names)

    names = [x.split()[0] for x in parts.split(", ")]
    got = docs.select("text", "doc_id", "held_out", "text_hash").mapInArrow(run, parts)
    # k = 0 marks a row of a text itself, which meets no count
    met = got.alias("a").join(counts.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.k") > 0), "left")
    value = F.when(F.col("a.k") > 0, F.col("a.k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    summed = met.groupBy("doc_id", "held_out", "text_hash").agg(
        F.sum((F.col("n_tokens") > 0).cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("a.k")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(value)).alias("base_score"),
        (F.sum("score") + F.sum(value)).alias("score"),
    )
    # rows repeated in id and text were summed together
    each = lambda c: (F.col(c) / F.col("copies")).cast("double").alias(c)
    whole = lambda c: F.expr(f"{c} div copies").alias(c)
    one = summed.select("doc_id", "held_out", whole("n_tokens"), whole("n_known"), each("base_score"), each("score"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def train_and_score(docs: DataFrame) -> DataFrame:
    """What the query returns, for docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    use_shared_folder(spark)
    learn = docs.filter("not held_out")
    path = f"{spark.sparkContext.getCheckpointDir()}/counts-{uuid.uuid4().hex}"
    token_counts(learn).write.parquet(path)  # columns of numbers: a quarter of a checkpoint's bytes
    counts = spark.read.schema("h long, c long").parquet(path)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    hot, hot_counts = hot_tokens(counts)
    cold = counts.groupBy(slot_column(F.col("h")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    hot_slots = (hot >> np.uint64(40)).astype(np.int64) % SLOTS
    rest = {r["k"]: (r["n"] - int(hot_counts[hot_slots == r["k"]].sum()), r["v"] - int((hot_slots == r["k"]).sum())) for r in cold}
    model = Model(hot, hot_counts, rest)
    lots = max(ROUNDS, -(-total // LOT_TOKENS))
    row = lambda i: F.xxhash64("doc_id", "text", F.lit(i))
    learn = learn.withColumns({"lot": F.pmod(row(1), F.lit(lots)), "order": row(2)})
    for i in range(ROUNDS):
        round_of_training(learn.filter(F.col("lot") % ROUNDS == i), model, RATE / (1 + i), -(-lots // ROUNDS))
    return scored(docs.withColumn("text_hash", F.xxhash64("text")), model, counts, total, distinct)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
    return train_and_score(docs)
