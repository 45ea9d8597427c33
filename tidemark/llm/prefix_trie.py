"""Operator 12: the trie of conversations by their first turns, built as a Patricia tree and expanded at the end.

A turn counts as the digest of its role and text; a conversation is a sequence of digests. The different sequences are
sorted, and the tree comes out of one pass over neighbours: their longest common beginnings are the branch points, and
with the sequences' own ends and leaves they are the only points made. Members, leaves, and bytes below a point are summed
up the compressed edges in that pass; each point carries the sums of bytes from each place of its edge to its end, from
which the nodes between two points are written out at last.

Sorted passes are cut into ranges, so one conversation, first turn or end with a third of all rows spreads over tasks:

* turns are sorted by conversation, families (those that borrow from one base) together. What a range needs of those
  before it is a count, at most BORROWED turns and a running hash, folded from one summary a range;
* sequences longer than CHUNK turns are cut into chunks; a chunk's group is the running hash of all turns before it, so a
  row holds at most CHUNK digests. Equal chunks are counted before they are sorted;
* a range of sorted chunks needs the depths of the points on its first and last path that other ranges make: CHUNK bits
  each, folded over one summary a range. Points that span ranges come as partial sums, which are added up;
* what lies below the ends of chunks is added to the points above by doubling: rounds grow with the logarithm of a path;
* ids that end at a node are sorted in ranges; a node within one range is digested there. Those that reach its edge travel
  as packed rows and are digested one after the other, in order, in constant memory.

The driver holds one summary a range: a few kilobytes each, whatever the rows.

A node is known by its depth and a running hash of its turns (a polynomial over the field of 2^127 - 1 elements, of halves
of SHA-256), so two nodes are taken for one with a probability near depth * nodes^2 / 2^127.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text counts as empty; null
turns come first, and equal turns of a conversation are ordered by the digest of role and text, repeated rows each being a
turn; a conversation all whose turns fall away is a member of the root alone; conv_id - conv_id % n truncates towards zero,
so below zero families go upwards; very long texts count by their bytes and very many turns go in chunks; an empty table
gives an empty table (no root); other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Conversations c - c % FAMILY lend up to BORROWED - 1 of their first turns to those that follow.
FAMILY, BORROWED = 5, 9
#: Turns in a row of the sorted table.
CHUNK = 256
#: Bytes of a digest, ids in a packed row.
WIDE, PACKED = 16, 4096
FIELD, BASE = (1 << 127) - 1, 0x5A8279996ED9EBA18F1BBCDCCA62C1D7 % ((1 << 127) - 1)
NOTHING = hashlib.sha256(b"").hexdigest()


def stepped(h: int, turn: bytes) -> int:
    return (h * BASE + int.from_bytes(turn) + 1) % FIELD


def as_bytes(h: int) -> bytes:
    return h.to_bytes(WIDE)


def taken_from_base(conv: int, family: int) -> int:
    return 0 if conv == family else crc32(str(conv).encode()) % BORROWED


# turns in their conversations' order


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """part, conv, family, turn (its digest), size (bytes of its text): sorted by family, conversation and turn over ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDE))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), family.cast("long").alias("family"), F.col("turn").alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("size"))
    # the last part only divides repeated rows between ranges
    order = [F.col("family"), F.col("conv") != F.col("family"), F.col("conv"), F.col("at").asc_nulls_first(), F.col("turn"), F.col("any")]
    rows = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(rows.select(F.spark_partition_id().alias("part"), "conv", "family", "turn", "size"))


TURNS_OF_RANGE = "part int, head long, conv long, family long, first array<binary>, sizes array<long>, rest binary, n_rest long, lent array<binary>, lent_sizes array<long>"


def ranges_of_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: its last conversation's first turns and a hash of the rest, and what its family's base lends."""
    part = conv = family = head = None
    first: list[tuple[bytes, int]] = []
    lent: list[tuple[bytes, int]] = []
    rest = n_rest = 0
    for batch in batches:
        for part, c, f, turn, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if head is None:
                head = c
            if f != family:
                lent = []
            if c != conv:
                first, rest, n_rest = [], 0, 0
            conv, family = c, f
            if c == f and len(lent) < BORROWED - 1:
                lent.append((turn, size))
            if len(first) < BORROWED - 1:
                first.append((turn, size))
            else:
                rest, n_rest = stepped(rest, turn), n_rest + 1
    if part is not None:
        columns = [part, head, conv, family, [t for t, _ in first], [s for _, s in first], as_bytes(rest), n_rest, [t for t, _ in lent], [s for _, s in lent]]
        names = [x.split()[0] for x in TURNS_OF_RANGE.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], names)


class Progress:
    """Where a pass over the ordered turns is: the conversation, its own turns so far, its rebuilt depth and hash, what the base lends."""

    def __init__(self) -> None:
        self.conv = self.family = None
        self.lent: list[tuple[bytes, int]] = []
        self.own = self.depth = self.hash = 0

    def copy(self) -> Progress:
        new = Progress()
        new.__dict__.update(self.__dict__, lent=list(self.lent))
        return new

    def begins(self, conv: int, family: int) -> list[tuple[bytes, int]]:
        """Goes on to a new conversation and returns the turns that it borrows."""
        if family != self.family:
            self.lent = []
        self.conv, self.family, self.own, self.depth, self.hash = conv, family, 0, 0, 0
        return self.lent[: taken_from_base(conv, family)]

    def counts(self, turn: bytes, size: int) -> bool:
        """Notes an own turn of the conversation; whether it stays in the rebuilt one."""
        self.own += 1
        if self.conv == self.family and len(self.lent) < BORROWED - 1:
            self.lent.append((turn, size))
        return self.own > taken_from_base(self.conv, self.family)

    def adds(self, turn: bytes) -> None:
        self.depth, self.hash = self.depth + 1, stepped(self.hash, turn)

    def passes(self, r: dict) -> None:
        """Goes over a range by its summary."""
        if r["conv"] != self.conv:
            if r["family"] != self.family or r["conv"] == r["family"]:
                self.lent = []
            if r["conv"] != r["family"] and r["lent"]:  # the base ends in this range, and may have begun before it
                before = self.lent if self.conv == r["family"] else []
                self.lent = [*before, *zip(r["lent"], r["lent_sizes"], strict=True)][: BORROWED - 1]
            self.family = r["family"]
            for turn, _ in self.begins(r["conv"], r["family"]):
                self.adds(turn)
        for turn, size in zip(r["first"], r["sizes"], strict=True):
            if self.counts(turn, size):
                self.adds(turn)
        self.own, self.depth = self.own + r["n_rest"], self.depth + r["n_rest"]
        self.hash = (self.hash * pow(BASE, r["n_rest"], FIELD) + int.from_bytes(r["rest"])) % FIELD


PIECE = "conv long, chunk long, off int, start binary, stop binary, key binary, sizes array<long>, ends boolean, more boolean, whole boolean"
PIECE_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.bool_()]
PIECE_NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Batches:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], most: int = 2_000_000) -> None:
        self.names, self.kinds, self.most, self.rows, self.held = names, kinds, most, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 100
        if self.held > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), self.kinds, strict=True)], self.names)
        self.rows, self.held = [], 0


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations in chunks: conv, chunk, start and stop (hashes), key (digests), sizes, ends, more.

    A conversation that goes over a range's end gives pieces (whole is false), which are put together afterwards.
    """
    found = sorted((r.asDict() for r in turns.mapInArrow(ranges_of_turns, TURNS_OF_RANGE).collect()), key=lambda r: r["part"])  # one row a range
    starts: dict[int, tuple[Progress, int | None]] = {}
    at = Progress()
    for i, r in enumerate(found):
        starts[r["part"]] = at.copy(), found[i + 1]["head"] if i + 1 < len(found) else None
        at.passes(r)
    held = turns.sparkSession.sparkContext.broadcast(starts)  # one entry a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, follows = Batches(PIECE_NAMES, PIECE_KINDS), None, None
        key, sizes, start, off, whole = [], [], 0, 0, True

        def piece(ends: bool, more: bool) -> Iterator[pa.RecordBatch]:
            done = whole and (ends or more)
            chunk = (now.depth - len(key) - off) // CHUNK
            return out.add((now.conv, chunk, off, as_bytes(start), as_bytes(now.hash), b"".join(key), list(sizes), ends, more, done), 24 * len(key))

        def turn_added(turn: bytes, size: int) -> Iterator[pa.RecordBatch]:
            nonlocal key, sizes, start, off, whole
            if off + len(key) == CHUNK:
                yield from piece(False, True)
                key, sizes, start, off, whole = [], [], now.hash, 0, True
            key.append(turn)
            sizes.append(size)
            now.adds(turn)

        for batch in batches:
            for part, conv, family, turn, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None:
                    before, follows = held.value[part]
                    now = before.copy()
                    full = now.depth > 0 and now.depth % CHUNK == 0  # then the range before has given the chunk as whole
                    start, off, whole = now.hash, 0 if full else now.depth % CHUNK, full
                    fresh = conv != now.conv
                else:
                    fresh = conv != now.conv
                    if fresh:
                        yield from piece(True, False)
                if fresh:
                    borrowed = now.begins(conv, family)
                    key, sizes, start, off, whole = [], [], 0, 0, True
                    for x in borrowed:
                        yield from turn_added(*x)
                if now.counts(turn, size):
                    yield from turn_added(turn, size)
        if now is not None:
            goes_on = follows is not None and follows == now.conv
            yield from piece(not goes_on, goes_on and off + len(key) == CHUNK)
        yield from out.out()

    pieces = checkpointed(turns.mapInArrow(run, PIECE))
    held.destroy()
    parts = F.sort_array(F.collect_list(F.struct("off", F.size("sizes").alias("n"), "start", "stop", "key", "sizes", "ends", "more")))  # at most CHUNK turns
    joined = pieces.filter("not whole").groupBy("conv", "chunk").agg(parts.alias("p")).select(
        "conv", "chunk", F.col("p")[0]["start"].alias("start"), F.element_at("p", -1)["stop"].alias("stop"), F.unhex(F.array_join(F.transform("p.key", F.hex), "")).alias("key"),
        F.flatten("p.sizes").alias("sizes"), F.exists("p", lambda x: x["ends"]).alias("ends"), F.exists("p", lambda x: x["more"]).alias("more"),
    )
    return pieces.filter("whole").drop("off", "whole").unionByName(joined)


# points of the compressed tree


def common(a: bytes, b: bytes) -> int:
    """Digests that two keys begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDE
    low, high = 0, n // WIDE  # the first low are common, the first high aren't
    while high - low > 1:
        mid = (low + high) // 2
        if a[WIDE * low : WIDE * mid] == b[WIDE * low : WIDE * mid]:
            low = mid
        else:
            high = mid
    return low


def upto(mask: int, depth: int) -> int:
    return mask & ((2 << depth) - 1) if depth >= 0 else 0


def depths(mask: int) -> list[int]:
    return [d for d in range(mask.bit_length()) if mask >> d & 1]


RANGE_OF_CHUNKS = "part int, chunk long, start binary, key binary, chunk_last long, start_last binary, key_last binary, first binary, last binary"


def ranges_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: its first and last key, and the points on their paths that the range itself makes, as bits."""
    head = group = part = None
    first = last = low = 0
    key = b""
    for batch in batches:
        for part, *g, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n = len(k) // WIDE
            if g != group:
                if head is None:
                    head, first, low = (*g, k), 1 | 1 << n, n
                else:
                    low = -1
                group, last = g, 1
            else:
                l = common(key, k)  # noqa: E741
                last = upto(last, l) | 1 << l
                if low >= 0:
                    low = min(low, l)
                    first |= 1 << low
            key, last = k, last | 1 << n
    if head is not None:
        wide = CHUNK // 8 + 1
        row = [part, *head, *group, key, first.to_bytes(wide), last.to_bytes(wide)]
        kinds = [pa.int32(), *[pa.int64(), pa.binary(), pa.binary()] * 2, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in RANGE_OF_CHUNKS.split(", ")])


def edges_of_ranges(found: list[dict]) -> dict[int, tuple[int, int, int, int]]:
    """For each range: what its first key has in common with the key before, the points on its path that earlier ranges make, and the same of its last key and later ranges. -1 if the key beside belongs to another group or there is none."""
    n = len(found)
    beside = [-1] * (n + 1)  # between range i - 1 and i
    for i in range(1, n):
        a, b = found[i - 1], found[i]
        if (a["chunk_last"], a["start_last"]) == (b["chunk"], b["start"]):
            beside[i] = common(a["key_last"], b["key"])
    inner = [common(r["key"], r["key_last"]) if (r["chunk"], r["start"]) == (r["chunk_last"], r["start_last"]) else -1 for r in found]
    lefts, rights, mask = [0] * n, [0] * n, 0
    for i in range(n):
        lefts[i] = upto(mask, beside[i]) | 1 << beside[i] if beside[i] >= 0 else 0
        mask = int.from_bytes(found[i]["last"]) | upto(lefts[i], inner[i])
    mask = 0
    for i in reversed(range(n)):
        rights[i] = upto(mask, beside[i + 1]) | 1 << beside[i + 1] if beside[i + 1] >= 0 else 0
        mask = int.from_bytes(found[i]["first"]) | upto(rights[i], inner[i])
    return {r["part"]: (beside[i], lefts[i], beside[i + 1], rights[i]) for i, r in enumerate(found)}


POINT = "depth long, id binary, up_depth long, up_id binary, conv_id long, n_convs long, n_children long, n_leaves long, paid long, once long, goes_on long, suffix array<long>, partial boolean"
POINT_NAMES = [x.split()[0] for x in POINT.split(", ")]
POINT_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.bool_()]


class Point:
    """A point on the path of the row that a pass is at. paid: bytes below it for each member; once: for each node."""

    __slots__ = ("depth", "n", "conv", "children", "met", "leaves", "paid", "once", "goes_on", "own", "spans")

    def __init__(self, depth: int, spans: bool) -> None:
        self.depth, self.spans = depth, spans  # spans: the range's first path, which an earlier range shares, goes through it
        self.n = self.children = self.leaves = self.paid = self.once = self.goes_on = 0
        self.conv, self.own, self.met = None, False, False


def points(chunks: DataFrame) -> DataFrame:
    """The compressed tree: one row a point, with its edge's suffix sums; partial rows are to be added up."""
    different = chunks.groupBy("chunk", "start", "key").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.sum(F.col("more").cast("long")).alias("goes_on"), F.min("conv").alias("conv"))
    order = ["chunk", "start", "key"]
    rows = different.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select(F.spark_partition_id().alias("part"), *order, "sizes", "n", "goes_on", "conv"))
    found = sorted((r.asDict() for r in rows.select("part", *order).mapInArrow(ranges_of_chunks, RANGE_OF_CHUNKS).collect()), key=lambda r: r["part"])  # one row a range
    held = rows.sparkSession.sparkContext.broadcast(edges_of_ranges(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(POINT_NAMES, POINT_KINDS)
        stack: list[Point] = []
        group, key, started = None, b"", False
        before = after = -1
        left = right = 0
        sums, hashes = [0], [0]  # of the path of the row before: bytes and hash up to each depth

        def given(v: Point, u: Point | None, partial: bool) -> Iterator[pa.RecordBatch]:
            chunk, start = group
            d = CHUNK * chunk
            if u is None:  # the root of a group: that of the tree, or what the end of a chunk has below it
                counted = (v.conv, v.n) if not chunk else (None, 0)
                row = (d, as_bytes(hashes[0]), None, None, *counted, v.children, v.leaves, v.paid, v.once, v.goes_on, None, partial or chunk > 0)
                return out.add(row, 0)
            suffix = [sums[v.depth] - x for x in sums[u.depth : v.depth]]
            partial = partial or v.depth == CHUNK and v.goes_on > 0
            row = (d + v.depth, as_bytes(hashes[v.depth]), d + u.depth, as_bytes(hashes[u.depth]), v.conv, v.n, v.children, v.leaves, v.paid, v.once, v.goes_on, suffix, partial)
            return out.add(row, 8 * len(suffix))

        def left_behind(v: Point, u: Point, extends: bool = False, reaches: int = -1) -> Iterator[pa.RecordBatch]:
            """v leaves the path below u. extends: the next range goes on below v; reaches: as deep as the next range's first path goes with this."""
            if v.own and not v.met and not v.goes_on and not extends:
                v.leaves += 1
            edge = sums[v.depth] - sums[u.depth]
            known = max(u.depth, before) if v.spans else u.depth
            u.n, u.leaves, u.goes_on, u.met = u.n + v.n, u.leaves + v.leaves, u.goes_on + v.goes_on, True
            u.paid += v.paid + v.n * edge
            u.once += v.once + max(0, sums[v.depth] - sums[min(known, v.depth)])
            u.children += not (v.spans and u.depth < before)
            u.conv = v.conv if u.conv is None else u.conv if v.conv is None else min(u.conv, v.conv)
            return given(v, u, v.spans or v.depth <= reaches)

        def closed(reaches: int = -1) -> Iterator[pa.RecordBatch]:
            """All points left on the path, with those that later ranges make on it."""
            for d in depths(right) if reaches >= 0 else ():
                i = next((i for i, v in enumerate(stack) if v.depth >= d), len(stack))
                if i == len(stack) or stack[i].depth > d:
                    stack.insert(i, Point(d, stack[i].spans if i < len(stack) else False))
            top = stack[-1] if stack else None
            while len(stack) > 1:
                v = stack.pop()
                yield from left_behind(v, stack[-1], v is top and reaches >= v.depth, reaches)
            if stack:
                v = stack.pop()
                v.leaves += v.own and not v.met and reaches < 0  # all conversations are turnless
                yield from given(v, None, v.spans or reaches >= 0)

        for batch in batches:
            for part, chunk, start, k, sizes, n, goes_on, conv in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not started:
                    before, left, after, right = held.value[part]
                if group == (chunk, start):
                    l = common(key, k)  # noqa: E741
                    while stack[-1].depth > l:
                        v = stack.pop()
                        if stack[-1].depth < l:
                            stack.append(Point(l, v.spans))
                        yield from left_behind(v, stack[-1])
                else:
                    yield from closed()
                    goes_before = not started and before >= 0
                    group, l = (chunk, start), 0  # noqa: E741
                    hashes, sums = [int.from_bytes(start)], [0]
                    stack = [Point(0, goes_before)] + [Point(d, True) for d in depths(left) if d and goes_before]
                del hashes[l + 1 :], sums[l + 1 :]
                for i in range(l, len(sizes)):
                    hashes.append(stepped(hashes[i], k[WIDE * i : WIDE * i + WIDE]))
                    sums.append(sums[i] + sizes[i])
                if stack[-1].depth < len(sizes):
                    stack.append(Point(len(sizes), not started and before >= 0))
                p = stack[-1]
                p.n, p.goes_on, p.own = p.n + n, p.goes_on + goes_on, True
                p.conv = conv if p.conv is None else min(p.conv, conv)
                key, started = k, True
        yield from closed(after)
        yield from out.out()

    made = checkpointed(rows.mapInArrow(run, POINT))
    held.destroy()
    added = {c: F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "paid", "once", "goes_on")}
    edge = F.first(F.when(F.col("suffix").isNotNull(), F.struct("up_depth", "up_id", "suffix")), ignorenulls=True)
    joined = made.filter("partial").groupBy("depth", "id").agg(F.min("conv_id").alias("conv_id"), edge.alias("e"), *(x.alias(c) for c, x in added.items()))
    whole = checkpointed(made.filter("not partial").drop("partial").unionByName(joined.select("depth", "id", "e.*", "conv_id", *added)))
    return below_chunks(whole) if any(r["chunk_last"] for r in found) else whole


def below_chunks(found: DataFrame) -> DataFrame:
    """points with what lies below the ends of chunks added to all points above, each round over paths twice as long."""
    sums = ("n_leaves", "paid", "once")
    ends = (F.col("depth") > 0) & (F.col("depth") % CHUNK == 0)
    place = lambda depth, i: F.when(F.col(depth).isNotNull(), F.struct(F.col(depth), F.col(i)))
    deep = found.filter("goes_on > 0").select(F.struct("depth", "id").alias("at"), place("up_depth", "up_id").cast("struct<depth:bigint,id:binary>").alias("up"), *(F.when(ends, F.col(c)).otherwise(0).alias(c) for c in sums))
    own, now = deep.select("at", *(F.col(c).alias(f"own_{c}") for c in sums)), checkpointed(deep)
    while not now.filter("up is not null").isEmpty():
        gets = now.filter("up is not null").groupBy(F.col("up").alias("at")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        ups = now.filter("up is not null").select(F.col("at").alias("up"), F.col("up").alias("next"))
        now = now.join(gets, "at", "left").join(ups, "up", "left")
        now = checkpointed(now.select("at", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)))
    extra = now.join(own, "at").select("at.depth", "at.id", *((F.col(c) - F.col(f"own_{c}")).alias(f"more_{c}") for c in sums))
    return checkpointed(found.join(extra, ["depth", "id"], "left").select(*(c for c in found.columns if c not in sums), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)))


# ids that end at a node


RUN = "depth long, id binary, first long, ids binary, sha string"


def packed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, id, conv): the digest of each node's ids, or packed ids for many of them and at both ends of a range."""
    out = Batches([x.split()[0] for x in RUN.split(", ")], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()])
    node, first, held, pack = None, None, [], True

    def given() -> Iterator[pa.RecordBatch]:
        if held:
            yield from out.add((*node, first, *((b",".join(held), None) if pack else (None, digest(held, None).hexdigest()))), 12 * len(held))

    for batch in batches:
        for depth, i, conv in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (depth, i) != node:
                yield from given()
                pack = node is None
                node, held = (depth, i), []
            elif len(held) == PACKED:
                pack = True
                yield from given()
                held = []
            if not held:
                first = conv
            held.append(str(conv).encode())
    pack = True
    yield from given()
    yield from out.out()


def digest(parts: list[bytes], sha: hashlib._Hash | None) -> hashlib._Hash:
    """The digest gone on with further ids, comma-joined."""
    if sha is None:
        return hashlib.sha256(b",".join(parts))
    sha.update(b"," + b",".join(parts))
    return sha


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ids in order, node by node, to one digest each."""
    out = Batches(["depth", "id", "sha"], [pa.int64(), pa.binary(), pa.string()])
    node, sha = None, None
    for batch in batches:
        for depth, i, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (depth, i) != node:
                if node is not None:
                    yield from out.add((*node, sha.hexdigest()), 64)
                node, sha = (depth, i), None
            sha = digest([ids], sha)
    if node is not None:
        yield from out.add((*node, sha.hexdigest()), 64)
    yield from out.out()


def ends(chunks: DataFrame) -> DataFrame:
    """depth, id, sha of each node at which conversations end."""
    rows = chunks.filter("ends").select((F.col("chunk") * CHUNK + F.size("sizes")).alias("depth"), F.col("stop").alias("id"), "conv")
    order = ["depth", "id", "conv"]
    runs = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed_ends, RUN))
    left = runs.filter("ids is not null").select("depth", "id", "first", "ids")
    joined = left.repartition("depth", "id").sortWithinPartitions("depth", "id", "first").mapInArrow(digested, "depth long, id binary, sha string")
    return runs.filter("sha is not null").select("depth", "id", "sha").unionByName(joined)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations (conv_id, turn, role, text): see the contract's columns in ``query``."""
    chunks = rebuilt(ordered_turns(conversations))
    found = points(chunks)
    above = found.select(F.col("depth").alias("up_depth"), F.col("id").alias("up_id"), F.col("conv_id").alias("up_conv"))
    whole = found.join(ends(chunks), ["depth", "id"], "left").join(above, ["up_depth", "up_id"], "left")
    last = F.size("suffix") - 1

    def expanded(place: Column, is_point: Column, is_top: Column, below: Column) -> list[Column]:
        return [
            "conv_id", place.alias("depth"), F.when(is_top, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(is_point, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("paid") - F.col("once") + (F.col("n_convs") - 1) * below).alias("saved_tokens"), F.when(is_point, F.coalesce("sha", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
        ]

    root = whole.filter("suffix is null").select(*expanded(F.col("depth"), F.lit(True), F.lit(True), F.lit(0)))
    edges = whole.filter("suffix is not null").select("*", last.alias("_last"), F.posexplode("suffix").alias("_i", "_below"))
    nodes = edges.select(*expanded(F.col("up_depth") + 1 + F.col("_i"), F.col("_i") == F.col("_last"), F.col("_i") == 0, F.col("_below")))
    return root.unionByName(nodes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (longs) and ends_sha256 of each node."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
