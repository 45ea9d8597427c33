"""The corpus pipeline against its parts, computed plainly."""

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import byte_bpe, near_dedup, quality, registry, secret_scan


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.columns == docs.columns for s in stages[:4])
    kept = {r["doc_id"] for r in quality.query(spark, SF).filter("kept").collect()}
    assert {r["doc_id"] for r in stages[0].collect()} == kept
    classes = near_dedup.classes(stages[0].select("doc_id", "text"))
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(r["class_id"] for r in classes.select("class_id").distinct().collect())
    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    for r in stages[2].collect():
        assert not [s for s in secret_scan.all_spans(r["text"]) if s[1] < 3] and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or secret_scan.all_spans(before[r["doc_id"]])
    coder = byte_bpe.coder(*byte_bpe.default_vocabulary())
    texts = sorted(r["text"].encode() for r in stages[3].collect())
    assert sorted(coder.decode(r["ids"]) for r in stages[4].collect()) == texts


def test_run_gives_the_same_rows(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_mixture_takes_what_the_sql_takes(spark, stages):
    """Copies of each document by the mixture's DuckDB SQL over the stage's own input."""
    con = duckdb.connect()
    con.register("documents", stages[2].toPandas())
    taken = con.sql(registry.oracle_sql()["op6_mixing"]).df()
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in taken.itertuples() if r.size and int(r.taken / r.size + 0.5)}
    assert {r["doc_id"]: r["count"] for r in stages[3].groupBy("doc_id").count().collect()} == want


def test_odd_tables(spark, odd, empty, clashing, tmp_path):
    prose = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")  # of the odd rows alone the rules keep none
    for name, docs in (("odd", odd.unionByName(prose)), ("empty", empty), ("clashing", clashing.unionByName(prose, allowMissingColumns=True))):
        columns, out = docs.columns, [docs]
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SF).write.parquet(f"{tmp_path}/{name}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            out.append(docs)
        assert all(x.columns == columns for x in out[1:5])
        n = [x.count() for x in out]
        kept = quality.judge(out[0].select("doc_id", "text", "lang"), "doc_id").filter("kept").count()
        assert n[1] == kept and n[2] == near_dedup.classes(out[1].select("doc_id", "text")).select("class_id").distinct().count()
        assert n[3] == n[2] and n[5] == n[4] and (n[0] == 0) == (name == "empty") and (name == "empty" or n[1] > 0)
        assert {r["doc_id"] for r in out[4].collect()} <= {r["doc_id"] for r in out[3].collect()}
