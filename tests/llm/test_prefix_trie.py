"""The trie of conversations: against plain dictionaries and DuckDB SQL, over many ranges, short chunks, hot keys."""

import hashlib
import os
import random
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.test_oracle import rows
from tidemark.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns):
    """All nodes by dictionaries over whole tuples of turns."""
    own = {}
    for c, at, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            e = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((at is not None, at or 0, e, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h, base = crc32(str(c).encode()) % 9, c - abs(c) % 5 * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + (len(members) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if full[c] == k)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tried(spark, turns, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(turns, SCHEMA)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", ["op11_importance", "op12_prefix_trie", "op13_url_filter"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize(("seed", "parts", "chunk"), [(1, 1, 256), (2, 13, 256), (3, 13, 2), (4, 37, 3), (5, 7, 1), (6, 29, 4)])
def test_random_tries(spark, monkeypatch, seed, parts, chunk):
    """Few different turns, so many shared beginnings and ends; one very long conversation and many copies of it."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    draw = random.Random(seed)
    turns = []
    for _ in range(60):
        c = draw.randrange(-30, 90)
        for at in range(draw.choice((1, 2, 3, 8, 9, 12))):
            turns.append((c, draw.choice((at, at, at, None)), draw.choice("ua"), draw.choice(("é", "x", "x", "xx"))))
    long = [draw.choice("ab") for _ in range(40)]
    for c in (7, 8, 9, 200, 201, 205, 210, 215):
        turns += [(c, 100 + i, "u", t) for i, t in enumerate(long[: draw.choice((40, 40, 25, 33))])]
    turns += [(300 + 5 * i, j, "u", "xx"[: j + 1]) for i in range(30) for j in range(3)]
    draw.shuffle(turns)
    assert tried(spark, turns, parts) == plain(turns)


def test_odd_rows(spark):
    turns = [(None, 1, "u", "lost"), (1, None, None, None), (1, None, None, None), (1, 1, "", ""), (2, 3, "u", "x" * 300_000), (2, 3, "u", "x" * 300_000), (3, 1, "u", None), (10, 0, "u", "a"), (11, 0, "u", "b"), (10, 0, "u", "a")]
    turns += [(15, i, "u", str(i)) for i in range(600)] + [(16, i, "u", str(i)) for i in range(590)]
    assert tried(spark, turns, 5) == plain(turns)
    assert tried(spark, [(1, 0, "u", "a")], 3) == plain([(1, 0, "u", "a")])  # the base is absent
    assert tried(spark, [], 3) == [] and tried(spark, [(None, 1, "u", "a")], 3) == []
    from pyspark.sql import functions as F

    names = ["conv", "family", "at", "size", "part", "any", "key", "depth", "id", "chunk", "start", "n"]
    df = spark.createDataFrame(turns, SCHEMA).select("*", *(F.lit(1).alias(n) for n in names))
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == plain(turns)


def test_many_ids_end_at_one_node():
    """Packed ids are digested as one text, whatever the ranges and packs that they come in."""
    ids = sorted(random.Random(0).sample(range(10**6), 20_000))
    ends = [(1, b"a", 5)] + [(1, b"b", i) for i in ids] + [(2, b"a", 6), (2, b"a", 7), (2, b"c", 8)]
    for cuts in ([0, len(ends)], [0, 1, 4097, 12_000, len(ends)], [0, 5000, 20_002, len(ends)], [0, 4096, 8193, 20_003, len(ends)]):
        packed, shas = [], {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ends[a:b], strict=True)], ["depth", "id", "conv"])
            for batch in prefix_trie.packed_ends(iter([part.slice(0, 100), part.slice(100)])):
                for r in batch.to_pylist():
                    if r["sha"] is None:
                        assert r["ids"].count(b",") < prefix_trie.PACKED
                        packed.append(r)
                    else:
                        assert shas.setdefault((r["depth"], r["id"]), r["sha"]) == r["sha"]
        packed.sort(key=lambda r: (r["depth"], r["id"], r["first"]))
        table = pa.RecordBatch.from_pylist(packed)
        for batch in prefix_trie.digested(iter([table])):
            for r in batch.to_pylist():
                assert (r["depth"], r["id"]) not in shas
                shas[r["depth"], r["id"]] = r["sha"]
        sha = lambda *x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert shas == {(1, b"a"): sha(5), (1, b"b"): sha(*ids), (2, b"a"): sha(6, 7), (2, b"c"): sha(8)}
