import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.conftest import SF
from tidemark.llm import byte_bpe

PATH, PATTERN = byte_bpe.default_vocabulary()


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_as_the_library(exact):
    c, rng = byte_bpe.coder(PATH, PATTERN), random.Random(4)
    letters = [chr(i) for i in range(0x250)] + list(" 　​中\U0001f600́\x1c\x85ſ")
    for k in range(4000):
        text = "".join(rng.choice(letters if k % 2 else "ab 's\n\t. 1é") for _ in range(rng.randrange(40)))
        assert [int(x) for b in c.blocks(text) for d, _ in b for x in d.split()] == exact.encode_ordinary(text)


def test_one_very_long_match(exact):
    c = byte_bpe.coder(PATH, PATTERN)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    assert [int(x) for b in c.blocks(text) for d, _ in b for x in d.split()] == exact.encode_ordinary(text)


def test_query_and_round_trip(spark, exact):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = exact.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() and r["round_trip"]


def test_odd_rows(odd, empty, clashing, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 1000)
    for docs in (odd, clashing):
        coded = byte_bpe.encode(docs, PATH, PATTERN, ["doc_id", "text"], outputs=("n_tokens", "ids", "decoded"))
        rows = coded.collect()
        assert len(rows) == 11 and all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) for r in rows)
        assert sorted(bytes(r["decoded"]) for r in byte_bpe.decode(coded.select("doc_id", "ids"), PATH, PATTERN, ["doc_id"]).collect()) == sorted(bytes(r["decoded"]) for r in rows)
    assert byte_bpe.encode(empty, PATH, PATTERN, ["doc_id"]).count() == 0


def test_matches_around_the_width_of_a_node(exact):
    c, rng, fan = byte_bpe.coder(PATH, PATTERN), random.Random(6), byte_bpe.FAN
    for n in (2, fan - 1, fan, fan + 1, 2 * fan, fan * fan - 1, fan * fan, fan * fan + 1):
        for letters in ("a", "ab", "abcdefgh"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert [int(x) for b in c.blocks(text) for d, _ in b for x in d.split()] == exact.encode_ordinary(text)
