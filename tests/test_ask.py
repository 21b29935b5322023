from __future__ import annotations

from pyspark.sql import functions as F

from docloom import pipeline as P
from docloom.operators import enrich as E
from docloom.operators.store import Store
from docloom.sources import ooxml as X

QUESTION = "qid long, question string, kb_id int, k int, threshold double"


def stored(spark, tmp_path, make):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(X.write_docx(["甲方公司", "乙方公司", "丙方公司"]))
    store = Store(spark, f"file://{tmp_path}/store")
    return P.ingest(spark, f"file://{tmp_path}/in", store, 1, make=make), store.read("chunks")


def test_ingest_stores_vectors(spark, tmp_path, as_rows):
    class Deaf(E.Offline):  # local, so that it's sent to the workers by value
        def embed(self, texts):
            return [None if "乙" in t else v for t, v in zip(texts, E.Offline.embed(self, texts))]

    report, kept = stored(spark, tmp_path, Deaf)
    assert as_rows(report, "chunks", "vectors", "failed", "stored") == [(3, 2, 1, 2)]
    assert as_rows(kept, "content") == [("丙方公司",), ("甲方公司",)] and all(len(r.vector) == 64 for r in kept.collect())


def test_ask_finds_without_a_shared_term(spark, tmp_path, as_rows):
    _, kept = stored(spark, tmp_path, E.Offline)
    q = spark.createDataFrame([(1, "甲", 1, 8, None), (2, "方公司", 1, 8, None), (3, "", 1, 8, None), (4, "甲", 9, 8, None)], QUESTION)
    want = [(1, True, 3), (2, True, 3), (3, False, 0), (4, False, 0)]
    assert as_rows(P.ask(q, kept, hybrid=True), "qid", "success", "total_sources") == want
    assert as_rows(P.ask(q, kept.drop("vector"), hybrid=True), "qid", "success", "total_sources") == want
    assert as_rows(P.ask(q, kept), "qid", "success", "total_sources")[0] == (1, False, 0)


def test_each_question_has_its_own_k_and_threshold(spark, as_rows):
    texts = [(1, f"c{i}", "text", f"word{i} " + "apple " * i, None) for i in range(1, 31)]
    chunks = spark.createDataFrame(texts, "kb_id int, chunk_id string, chunk_type string, content string, doc_id string")
    for c in ("description", "keywords", "table_id", "original_filename"):
        chunks = chunks.withColumn(c, F.lit(""))
    chunks = chunks.withColumn("row_no", F.lit(1)).withColumn("paragraph_index", F.lit(1))
    q = spark.createDataFrame([(1, "apple", 1, 20, None), (2, "apple", 1, 3, None), (3, "apple", 1, None, None), (4, "apple", 1, 20, 9.0)], QUESTION)
    assert as_rows(P.ask(q, chunks), "qid", "total_sources", "error") == [(1, 20, None), (2, 3, None), (3, 8, None), (4, 0, "nothing found")]
    q = q.where("qid <> 4").union(spark.createDataFrame([(4, "apple", 1, 20, 0.99)], QUESTION))
    got = as_rows(P.ask(q, chunks, hybrid=True), "qid", "total_sources")
    assert got[:3] == [(1, 20), (2, 3), (3, 8)] and got[3][1] < 20


def test_a_text_asked_by_many_is_embedded_once(spark, tmp_path, as_rows):
    _, kept = stored(spark, tmp_path, E.Offline)
    calls = spark.sparkContext.accumulator(0)

    class Counting(E.Offline):  # local, so that it's sent to the workers by value
        def embed(self, texts):
            calls.add(len(texts))
            return E.Offline.embed(self, texts)

    q = spark.createDataFrame([(i, "方公司" if i < 9 else "甲方", 1, i % 3 + 1, None) for i in range(10)], QUESTION)
    got = P.ask(q, kept, Counting, hybrid=True)
    assert as_rows(got, "qid", "total_sources") == [(i, i % 3 + 1) for i in range(10)] and calls.value == 2
