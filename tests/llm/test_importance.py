"""Importance resampling against a plain version that lists every feature."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target):
    def features(text):
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    all_, aim = Counter(f for _, t in docs for f in features(t)[1]), Counter(f for t in target for f in features(t)[1])
    s, t = sum(all_.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((all_[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        n, of = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in of)
        out.append([i, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n >= 20])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for r, x in enumerate(may[: 5 * len(may) // 100]):
        x[4] = r + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("bits", [2, 12])
def test_against_the_plain_version(spark, odd, clashing, monkeypatch, bits):
    """Odd rows, copies of one row (a third of all), equal scores, ids beyond 32 bits and without a value."""
    monkeypatch.setattr(importance, "DIGIT_BITS", bits)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(1000 + i, " ".join(f"W{(i * j) % 37}x-{j}" for j in range(5 + i % 40))) for i in range(300)]
    rows += [(77, " ".join(f"copy{j}" for j in range(30)))] * 150 + [(None, "a B c " * 20)] * 30 + [((1 << 62) + 5, "q r s " * 10), (-(1 << 62), "q r s " * 10)]
    target = ["copy1 copy2 copy3 copy4", None, "w1x w2x", "", "the cat sat on the mat"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in importance.resample(docs, aim).collect()), key=str)
    assert got == plain(rows, target)
    if bits == 12:
        none = aim.limit(0)
        mine = [(r["doc_id"], r["text"]) for r in clashing.collect()]
        assert sorted((tuple(r) for r in importance.resample(clashing.withColumns({"row": F.lit(1), "weight": F.lit(2), "nameless": F.lit(3)}), none).collect()), key=str) == plain(mine, [])


def test_every_cut_is_exact(spark, monkeypatch):
    """The first k by the key, for every k, among many ties."""
    monkeypatch.setattr(importance, "DIGIT_BITS", 3)
    rows = [(i * 37 % 5 - 2, int(i % 7 == 0), i % 3 - 1, (i * 91) % 11, i % 2, i) for i in range(40)]
    df = spark.createDataFrame(rows, "score long, nameless long, id_high long, id_low long, n_features long, row long").cache()
    ordered = sorted(rows, key=lambda r: (-r[0], *r[1:]))
    for k in range(1, 41, 3):
        assert sorted(tuple(r) for r in df.filter(importance.cut(df, k)).collect()) == sorted(ordered[:k])


def test_empty_and_long(spark, empty):
    aim = spark.createDataFrame([("a b c",)], "text string")
    assert importance.resample(empty, aim).count() == 0
    text = "ab cd " * 700_000 + "y" * 3_000_000 + " ab cd"  # several blocks, and a word longer than a block
    n = sum(len(of) for _, of in importance.feature_buckets(text))
    assert n == 3 * 1_400_003 - 3 and sum(k for k, _ in importance.feature_buckets(text)) == 1_400_003
