"""Operator 3: near-duplicate classes by improved consistent weighted sampling.

A document's shingles of five words weigh tf * (1 + WEIGHT * idf / log(n + 1)): TF-IDF with the idf scaled to the range
0 to 1 at any corpus size n. The document frequencies are counts of hashed shingles over all documents in a table of
fixed size: a collision adds to all frequencies in the same proportion, so frequent passages stand out alike. Each of
BANDS * ROWS samplers draws the shingle and level that improved consistent weighted sampling (Ioffe 2010) prescribes;
two documents draw alike with the probability of their weighted Jaccard similarity. ROWS samples make a band; at
similarity 0.8 a pair misses all bands with probability 0.0008. A pair is a link if its weighted Jaccard similarity,
from the whole texts, is at least SIMILARITY; classes are the components of the links.

WEIGHT is small on purpose: the shingles that thousands of copies share are frequent, those of their edits are rare, so
with a full idf (1 + idf) a large group of near copies falls apart (README has figures).

Exact copies (equal words in order) are one node, named by the digest of its words. Nodes that share a band are
candidates. Links are sought in three steps, each followed by joining what it linked:

1. Every node meets one leader: of the leaders of its buckets, the one that it shares most bands with. A bucket's leader
   is the node whose own buckets are largest, so in a group of copies one near its middle.
2. In buckets that still hold several classes, members meet DRAWS leaders drawn by a hash.
3. Every pair of a bucket whose classes still differ is tried: in buckets of at most WHOLE members as they are, in
   larger ones the pairs that share one of their rarest shingles. At SIMILARITY a pair shares one of the first fifth or
   so of its shingles in any fixed order (prefix filter), so that loses no pair, and in the order of document
   frequencies what a large bucket has in common comes last. From their first common shingle on, both texts must have
   the weight that similar texts have in common (positional filter). A pair of two classes has a side outside the
   largest class of its cell, so only these sides are held against the cell.

The number of steps is fixed, so plans and the driver's memory don't grow. To compare pairs, their cells are cut into
blocks of about BLOCK nodes, long texts (LONG bytes) being blocks of their own, so that a task never holds more than two
blocks' shingles; a text travels once to each pair of blocks where it is needed, not once for each pair.

Defined cases: a null text counts as empty; documents without words are equal texts, one class; fewer than five words
make one shingle, so very short texts are alike only if equal; very long texts are used whole; ties of leaders are
broken by digests; a null id belongs to a class, but names it only if all ids of the class are null, then by a negative
number from the text; rows that share an id but not the words are different nodes; of a class's rows with its least id,
the least by digest and by a hash of the row stands for it; repeated rows are copies; an empty table gives an empty
table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, gives_back, let, table, word_list
from .hashing import counted, mix, normal, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
WEIGHT = 0.2
#: Counters of document frequencies: 2 ** 20 of 4 bytes.
FEATURE_BITS = 20
LEVELS = 1 << 16
#: Leaders of a bucket in the second step, and members of a bucket that is compared whole in the third.
DRAWS, WHOLE = 3, 16
#: Nodes of a cell that are compared with as many at once, and bytes of words from which a node is a block of its own.
BLOCK, LONG = 128, 1 << 18


def _features(text: str | None) -> np.ndarray:
    return np.unique(shingles(word_hashes(normal(text)), SHINGLE) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    return counted(docs.select("text"), 1 << FEATURE_BITS, lambda: _features)


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + WEIGHT * idf of each hashed shingle, the idf scaled to at most 1."""
    return (1 + WEIGHT * np.log((n + 1) / (np.minimum(counts, n).astype(np.float64) + 1)) / math.log(n + 2)).astype(np.float32)


def weighted(solid: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in ascending order, and their weights."""
    found, tf = np.unique(shingles(word_hashes(solid), SHINGLE), return_counts=True)
    return found, tf.astype(np.float32) * idf[(found >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]


@cache
def _samplers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A seed for each sampler, and the quantiles of Gamma(2, 1) and of its logarithm at LEVELS places.

    The quantiles are found by Newton's method from p = 1 - (1 + x) exp(-x).
    """
    p = (np.arange(LEVELS) + 0.5) / LEVELS
    x = np.where(p < 0.5, np.sqrt(2 * p), 2 - 1.3 * np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)), x.astype(np.float32), np.log(x).astype(np.float32)


def sample(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each sampler draws: a 64-bit hash of its shingle and level."""
    seeds, gamma, log_gamma = _samplers()
    best = np.full(len(seeds), np.inf, np.float32)
    drawn = np.zeros(len(seeds), np.uint64)
    logs = np.log(weights)
    columns = np.arange(len(seeds))
    for i in range(0, len(found), 2048):
        z = mix(found[i : i + 2048, None] ^ seeds)
        r = gamma[z >> np.uint64(48)]
        beta = (z & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32)
        level = np.floor(logs[i : i + 2048, None] / r + beta)
        cost = log_gamma[(z >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (level - beta + np.float32(1))
        row = cost.argmin(0)
        least = cost[row, columns]
        better = least < best
        best = np.where(better, least, best)
        drawn = np.where(better, mix(found[i + row] + level[row, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), drawn)
    return drawn


def bands(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(0, np.int64)
    drawn = sample(found, weights).reshape(BANDS, ROWS)
    key = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for i in range(ROWS):
        key = mix(key + drawn[:, i])
    return key.view(np.int64)


def sketched(docs: DataFrame, held: Broadcast) -> DataFrame:
    """doc_id, copy (digest of the words) and bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            for lot in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                copies, keys = [], []
                for text in lot.column(1):
                    solid = normal(text.as_py())
                    copies.append(hashlib.md5(solid).digest() + b"L" * (len(solid) >= LONG))
                    keys.append(bands(*weighted(solid, idf)))
                yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(copies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "copy", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: gives_back(run(batches)), "doc_id long, copy binary, bands array<long>")


def nameless(copy: Column | str) -> Column:
    """A negative number that stands for a text whose rows have no id."""
    return F.xxhash64(copy).bitwiseOR(F.lit(-(1 << 63)))


def digest() -> Column:
    """The digest of the words of the column text, as ``sketched`` makes it; a further byte marks long ones."""
    return let(F.array_join(word_list(F.col("text")), " "), lambda x: F.concat(F.unhex(F.md5(x.cast("binary"))), F.when(F.octet_length(x) >= LONG, F.lit(b"L")).otherwise(F.lit(b""))))


def met_texts(docs: DataFrame, wanted: DataFrame, keep: list[str]) -> DataFrame:
    """node, text and ``keep`` of the rows of docs that have the id and the words of a wanted node (id, node)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless(digest())).alias("id"), "text", *keep)
    return rows.join(wanted, "id").filter(digest() == F.col("node")).select("node", "text", *keep)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima; 1 for two empty texts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / total if total else 1.0


def verified(pairs: DataFrame, texts: DataFrame, held: Broadcast) -> DataFrame:
    """Labels a and b of the pairs (cell, n, a, b, label_a, label_b) of nodes that are similar enough.

    n is the size of the cell that the pair comes from: it is cut into blocks, and the pairs of two blocks form a lot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, lot, known = held.value, None, {}
        for batch in batches:
            lots, a_s, b_s = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for k, own in enumerate(lots):
                if own != lot:
                    lot, known = own, {}
                if b_s[k] is None:  # a text; in each lot they come first
                    known[a_s[k]] = weighted(normal(batch.column(6)[k].as_py()), idf)
                elif similarity(known[a_s[k]], known[b_s[k]]) >= SIMILARITY:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(4).take(at), batch.column(5).take(at)], ["a", "b"])

    # memory is bounded by bytes: long texts, which their digests mark, are blocks of one
    block = lambda c: F.when(F.octet_length(c) > 16, F.xxhash64(c)).otherwise(F.pmod(F.xxhash64(c), F.ceil(F.col("n") / BLOCK)))
    # used twice
    dealt = checkpointed(pairs.select(F.xxhash64("cell", block("a"), block("b")).alias("lot"), "a", "b", "label_a", "label_b"))
    # a lot has at most two blocks of nodes
    nodes = dealt.groupBy("lot").agg(F.array_union(F.collect_set("a"), F.collect_set("b")).alias("nodes"))
    needed = nodes.select("lot", F.explode("nodes").alias("node"))
    none = F.lit(None).cast("binary")
    first = needed.join(texts, "node").select("lot", F.lit(0).alias("turn"), F.col("node").alias("a"), none.alias("b"), none.alias("label_a"), none.alias("label_b"), "text")
    both = first.unionByName(dealt.select("lot", F.lit(1).alias("turn"), "a", "b", "label_a", "label_b", F.lit(None).cast("string").alias("text")))
    return both.repartition("lot").sortWithinPartitions("lot", "turn").mapInArrow(lambda batches: gives_back(run(batches)), "a binary, b binary").distinct()


def pair(a: str, b: str) -> list[Column]:
    """The columns of a pair in a fixed order of its sides, so that it is the same from either side."""
    first = F.col(a) < F.col(b)
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return [side(a, b).alias("a"), side(b, a).alias("b"), side(f"{a}_label", f"{b}_label").alias("label_a"), side(f"{b}_label", f"{a}_label").alias("label_b")]


def once(pairs: DataFrame) -> DataFrame:
    """Each pair in the least of its cells, so that the pairs of a node share cells and its text travels to few lots."""
    least = pairs.groupBy("a", "b", "label_a", "label_b").agg(F.min(F.struct("cell", "n")).alias("at"))
    return least.select("at.cell", "at.n", "a", "b", "label_a", "label_b")


def with_one_leader(members: DataFrame) -> DataFrame:
    """Pairs of each node and the leader that it shares most bands with. members: key, n (its size), node, sum (of n)."""
    leaders = members.groupBy("key").agg(F.max_by("node", F.struct("sum", "node")).alias("leader"))
    met = members.join(leaders, "key").filter(F.col("node") != F.col("leader"))
    found = met.groupBy("node").agg(F.collect_list(F.struct("leader", "n", "key")).alias("in"))  # at most BANDS buckets
    own = lambda leader: F.filter("in", lambda x: x["leader"] == leader)
    shared = lambda leader: F.struct(F.size(own(leader)).alias("bands"), F.array_max(F.transform(own(leader), lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key")))).alias("at"), leader.alias("leader"))
    best = found.select("node", F.array_max(F.transform(F.array_distinct("in.leader"), shared)).alias("x"))
    return best.select(F.col("x.at.key").alias("cell"), F.col("x.at.n").alias("n"), F.col("node").alias("a"), F.col("x.leader").alias("b"), F.col("node").alias("label_a"), F.col("x.leader").alias("label_b"))


def with_drawn_leaders(members: DataFrame) -> DataFrame:
    """Pairs of members of a bucket with some of its nodes that have another label. members: key, n, node, label."""
    drawn = F.array(*(F.min_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(i))) for i in range(DRAWS)))
    leaders = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array_distinct(drawn).alias("drawn"))
    leaders = leaders.filter("low <> high").select("key", F.explode("drawn").alias("x")).select("key", F.col("x.node").alias("leader"), F.col("x.label").alias("leader_label"))
    met = members.withColumnRenamed("label", "node_label").join(leaders, "key").filter("node_label <> leader_label")
    return once(met.select(F.col("key").alias("cell"), "n", *pair("node", "leader")))


def prefix(found: np.ndarray, weights: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a text, one of which it shares with any text that is similar enough; the weight from each on."""
    order = np.lexsort((found, -idf[(found >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]))
    left = np.cumsum(weights[order][::-1].astype(np.float64))[::-1]
    n = int((left >= SIMILARITY * left[0] * (1 - 1e-5)).sum()) if len(found) else 0
    return found[order[:n]], left[:n]


def prefixes(nodes: DataFrame, texts: DataFrame, held: Broadcast) -> DataFrame:
    """node, label, weight, and each shingle of the prefix (cell) with the weight from it on (left), for nodes (node, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            for lot in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sums, kept, lefts = [], [], []
                for text in lot.column(2).to_pylist():
                    found, weights = weighted(normal(text), idf)
                    sums.append(float(weights.sum(dtype=np.float64)))
                    cells, left = prefix(found, weights, idf)
                    kept.append(cells.view(np.int64))
                    lefts.append(left)
                columns = [lot.column(0), lot.column(1), pa.array(sums, pa.float64()), pa.array(kept, pa.list_(pa.int64())), pa.array(lefts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "label", "weight", "cell", "left"])

    schema = "node binary, label binary, weight double, cell array<long>, left array<double>"
    got = nodes.join(texts, "node").select("node", "label", "text").mapInArrow(lambda batches: gives_back(run(batches)), schema)
    return got.select("node", "label", "weight", F.explode(F.arrays_zip("cell", "left")).alias("x")).select("node", "label", "weight", "x.cell", "x.left")


def outside(rows: DataFrame, cell: str) -> DataFrame:
    """The rows of cells with several labels, with the cell's size n and ``most``, the label that most of its rows have."""
    sizes = rows.groupBy(cell, "label").agg(F.count("*").alias("k"))
    cells = sizes.groupBy(cell).agg(F.sum("k").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("most"))
    return rows.drop("n").join(cells.filter("labels > 1").drop("labels"), cell)


def across(rows: DataFrame, cell: str, near: Column | None = None, *also: str) -> DataFrame:
    """The pairs of different labels in what ``outside`` gives, from the sides that don't have the label of most.

    near: what must hold besides, on the columns ``also`` of both sides, own_ and other_.
    """
    side = lambda name: [F.col("node").alias(name), F.col("label").alias(f"{name}_label"), *(F.col(c).alias(f"{name}_{c}") for c in also)]
    own, other = rows.filter("label <> most").select(F.col(cell).alias("cell"), "n", *side("own")), rows.select(F.col(cell).alias("cell"), *side("other"))
    met = own.join(other, "cell").filter(F.col("own_label") != F.col("other_label"))
    return once((met if near is None else met.filter(near)).select("cell", "n", *pair("own", "other")))


def pairs_left(members: DataFrame, texts: DataFrame, held: Broadcast) -> DataFrame:
    """Every pair of a bucket that has two labels and may be similar enough."""
    mixed = checkpointed(outside(members.select("key", "node", "label"), "key"))
    whole = across(mixed.filter(F.col("n") <= WHOLE), "key")
    large = mixed.filter(F.col("n") > WHOLE).select("node", "label").distinct()
    rare = checkpointed(outside(prefixes(large, texts, held), "cell"))
    # at their first common shingle both sides must still have what similar texts have in common
    near = F.least("own_left", "other_left") >= (SIMILARITY / (1 + SIMILARITY) - 1e-5) * (F.col("own_weight") + F.col("other_weight"))
    return whole.unionByName(across(rare, "cell", near, "weight", "left"))


def some(df: DataFrame) -> bool:
    """Whether df has a row; looks at a few partitions first, where ``isEmpty`` runs and shuffles all."""
    return bool(df.take(1))


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for the nodes of the links (a, b).

    In each round a node takes the label of the least label around it, so labels also jump. All joins are of rows that a
    shuffle has dealt already, hence the hint: broadcasts would read them again in stages of their own.
    """
    side = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    # a node is beside itself, so no label around it is the least that is above its own
    both = links.select(F.inline(F.array(side("a", "b"), side("b", "a"), side("a", "a"), side("b", "b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        # both joins need the labels by node: they are dealt once
        around = both.join(labels.alias("x").hint("merge"), F.col("b") == F.col("x.node")).groupBy("a")
        near = around.agg(F.min("x.label").alias("near"), F.max(F.when(F.col("a") == F.col("b"), F.col("x.label"))).alias("before"))
        found = near.join(labels.alias("y").hint("merge"), F.col("near") == F.col("y.node"))
        found = checkpointed(found.select(F.col("a").alias("node"), "before", F.col("y.label").alias("label")))
        labels = found.select("node", "label")
        if not some(found.filter("label <> before")):
            return labels


def roots(links: DataFrame) -> DataFrame:
    """node, label: where the path from a node ends, for links from a node (a) to the only one that it leads to (b), no circles.

    Paths double in each round.
    """
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        met = labels.alias("x").join(labels.alias("y").hint("merge"), F.col("x.label") == F.col("y.node"), "left")
        found = checkpointed(met.select(F.col("x.node").alias("node"), F.coalesce("y.label", "x.label").alias("label"), F.col("y.label").isNotNull().alias("moved")))
        labels = found.select("node", "label")
        if not some(found.filter("moved")):
            return labels


def relabelled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with their label replaced by that which names (node, label) have for it."""
    renamed = names.select(F.col("node").alias("label"), F.col("label").alias("_label"))
    return rows.join(renamed, "label", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, copy) of docs (doc_id, text), and nodes (node, id, nameless, label) of its different texts."""
    counts, n = document_frequencies(docs)
    held = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(counts, n))  # FEATURE_BITS bound it: 4 MB
    rows = checkpointed(sketched(docs, held))
    nodes = rows.groupBy(F.col("copy").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes.select("node", F.coalesce("doc_id", nameless("node")).alias("id"), F.col("doc_id").isNull().alias("nameless"), "bands"))
    keyed = nodes.select("node", "id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(shared, "key")
    sums = members.groupBy("node").agg(F.first("id").alias("id"), F.sum("n").alias("sum"), F.collect_list(F.struct("key", "n")).alias("in"))  # at most BANDS buckets
    grouped = checkpointed(sums)
    alone = nodes.select("node", "id", "nameless", F.col("node").alias("label"))
    if not some(grouped):
        return rows.select("doc_id", "copy"), alone
    texts = met_texts(docs, grouped.select("id", "node"), [])
    texts = checkpointed(texts.groupBy("node").agg(F.min("text").alias("text")))  # copies may differ in white space

    buckets = grouped.select("node", "sum", F.explode("in").alias("x")).select("x.key", "x.n", "node", "sum")
    label = grouped.select("node", F.col("node").alias("label"))
    # the leader of a bucket is the largest of it, so nodes and their leaders form trees
    for step, named in ((with_one_leader, roots), (with_drawn_leaders, components), (lambda x: pairs_left(x, texts, held), components)):
        members = buckets if named is roots else buckets.join(label, "node")
        found = checkpointed(verified(step(members), texts, held))
        if some(found):
            label = checkpointed(relabelled(label, named(found)))
    held.destroy()  # all that was made with it is in the shared folder
    named = alone.join(label.withColumnRenamed("label", "_label"), "node", "left").select("node", "id", "nameless", F.coalesce("_label", "label").alias("label"))
    return rows.select("doc_id", "copy"), named


def named_classes(nodes: DataFrame) -> DataFrame:
    """label, and the least (id, node) of each class."""
    return nodes.groupBy("label").agg(F.min(F.struct("nameless", "id", "node")).alias("first")).select("label", "first.id", "first.node")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), copy_id (of its exact copies), for each row of docs (doc_id, text)."""
    rows, nodes = labelled(docs)
    # classes and copies are equal numbers of rows or fewer: two joins of short columns
    of = nodes.join(named_classes(nodes).select("label", F.col("id").alias("class_id")), "label").select(F.col("node").alias("copy"), F.col("id").alias("copy_id"), "class_id")
    return rows.join(of, "copy").select("doc_id", "class_id", "copy_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stand for their class: one row for each class."""
    _, nodes = labelled(docs.select("doc_id", "text"))
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_hash"))
    met = met_texts(whole, named_classes(nodes).select("id", "node"), ["_row", "_hash"])
    return met.groupBy("node").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "copy_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stands_for_class"))
