"""The pipeline's stages on whole small tables, and the registered queries."""

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tessera.llm import scratch

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {n[: n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_dup", "decontam", "mix"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.saved(stage(spark, docs, SF), name)
        if name == "mix":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "lines":
            assert after == brute.line_dedup(list(before.items()))
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        else:
            assert all(before[i] == t for i, t in after.items())
        if name == "near_dup":
            assert set(after) == {i for i, (_, root) in brute.near_dups(list(before.items()), 5, 80).items() if i == root}
        texts = after
    taken = docs.agg(F.sum("size").alias("s"), F.sum("taken").alias("t")).first()
    assert docs.count() == len(texts) and abs(taken.s - taken.t) <= 0.02 * taken.s + 64 * 20


@pytest.mark.parametrize("name", ["op1_urls", "op7_near_dup", "op8_repeats", "op9_mixing", "op10_pii"])
def test_queries_cover_their_tables(spark, name):
    table = "pages" if name == "op1_urls" else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_contract_queries_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op7_near_dup"](spark, SF).collect()}
    assert near == brute.near_dups(docs, 3, 85)
    gone = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op8_repeats"](spark, SF).collect()}
    assert gone == brute.repeats(docs)
