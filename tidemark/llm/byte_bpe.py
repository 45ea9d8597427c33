"""Operator 1: byte-level BPE encoding and decoding with a segment tree.

A text is cut by the tokenizer's pattern and each match is merged on its own. The leaves of a segment tree hold, for
every live byte position, the rank of the pair that starts there; an inner node holds the least (rank, position) of the FAN
nodes below it, so the least of the top ones is the leftmost pair of least rank. A merge changes three leaves: the
merged position, its left neighbour and the position that vanishes. Each is a point update of logarithmic cost, so a
match of n bytes takes O(n log n) even if it is a whole document.

Defined cases: a null text counts as empty (no tokens, digests of the empty string); very long texts are matched piece by
piece and give what they would give at once; other columns don't matter; equal rows give equal results; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Matches whose tokens a Python worker remembers (about 300 bytes each) in each of two generations: when the younger is
#: full it becomes the older, whose matches come back as they are met.
REMEMBERED = 150_000
#: Children of a node of the tree: one call of ``min`` takes them all, and most matches are a single node.
FAN = 32
#: Texts of more characters are matched piece by piece, so that their matches are never all in memory.
LONG = 1_000_000
BLOCK = 65_536
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n, rank = len(piece), ranks.get
    never = 1 << 62  # above any rank * n + position
    leaves = [never] * n
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            leaves[i] = r * n + i
    inner, top = [], leaves  # nodes by level, from the leaves' parents up
    while len(top) > FAN:
        top = [min(top[i : i + FAN]) for i in range(0, len(top), FAN)]
        inner.append(top)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (least := min(top)) != never:
        i = least % n
        gone = after[i]
        end = after[i] = after[gone]
        leaves[i] = leaves[gone] = never
        if end < n:
            before[end] = i
            r = rank(piece[i : after[end]])
            if r is not None:
                leaves[i] = r * n + i
        left = before[i]
        if left >= 0:
            r = rank(piece[left:end])
            leaves[left] = never if r is None else r * n + left
        if inner:
            below, x, y, z = leaves, left if left >= 0 else i, i, gone
            for level in inner:
                x, y, z = x // FAN, y // FAN, z // FAN
                for k in {x, y, z}:
                    level[k] = min(below[k * FAN : (k + 1) * FAN])
                below = level
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class Coder:
    """Encodes and decodes by one vocabulary; remembers the ids of frequent matches."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.ranks = read_ranks(vocabulary)
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.seen: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def coded(self, match: str) -> tuple[str, bytes]:
        """The ids of a match as decimals, and the bytes that they decode to."""
        got = self.older.get(match)
        if got is None:
            ids = merge(match.encode(), self.ranks)
            got = " ".join(map(self.digits.__getitem__, ids)), self.decode(ids)
        if len(match) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.older = dict(self.seen)
                self.seen.clear()  # the same object, as blocks() holds its method
            self.seen[match] = got
        return got

    def _matches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def blocks(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """What ``coded`` gives for each match of a text, in one list or, if it is long, in several."""
        seen, coded = self.seen.get, self.coded
        for matches in self._matches(text):
            yield [seen(m) or coded(m) for m in matches]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def coder(vocabulary: str, pattern: str) -> Coder:
    """A Python worker reads a vocabulary once, for all its tasks."""
    return Coder(vocabulary, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Columns ``keep`` of df and what ``outputs`` names (keys of OUTPUTS) of the encoded texts.

    ``decoded`` and ``decoded_sha256`` come from the ids, not from the text.
    """

    def start() -> Callable[..., tuple]:
        c = coder(vocabulary, pattern)

        def row(value: str | None, *kept: object) -> tuple:
            n, all_ids, raw = 0, [], []
            ids_sha, raw_sha = hashlib.sha256(), hashlib.sha256()
            for block in c.blocks(value or ""):
                if not block:
                    continue
                decimals = " ".join([x[0] for x in block])
                ids_sha.update((f" {decimals}" if n else decimals).encode())
                raw_sha.update(back := b"".join([x[1] for x in block]))
                n += decimals.count(" ") + 1
                if "ids" in outputs:
                    all_ids.append(np.fromstring(decimals, np.int32, sep=" "))
                if "decoded" in outputs:
                    raw.append(back)
            got = {"n_tokens": n, "ids": np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), "ids_sha256": ids_sha.hexdigest(), "decoded": b"".join(raw), "decoded_sha256": raw_sha.hexdigest()}
            return (*kept, *(got[k] for k in outputs))

        return row

    kinds = dict(df.dtypes)
    return map_rows(df.select(text, *keep), ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{k} {OUTPUTS[k]}" for k in outputs]), start)


def decode(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` of df and ``decoded``, the bytes that the ids stand for; null ids count as none."""

    def start() -> Callable[..., tuple]:
        c = coder(vocabulary, pattern)
        return lambda value, *kept: (*kept, c.decode(value or []))

    kinds = dict(df.dtypes)
    return map_rows(df.select(ids, *keep), ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["decoded binary"]), start)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs.withColumn("source_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), vocabulary, pattern, ["doc_id", "source_sha256"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", (F.col("decoded_sha256") == F.col("source_sha256")).alias("round_trip"))
