from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import answer as A
from docloom.operators import retrieve as R
from docloom.operators import store as S


def test_filters_and_codec(spark, as_rows):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None)], "obj_id long, t string, chunk_id string")
    assert as_rows(S.delete_by_filter(df, S.Equal("t", "a")), "obj_id") == [(2,), (3,)]
    assert as_rows(S.filter_query(df, S.ContainsAny("t", ("a", "b")), limit=1, offset=1), "obj_id") == [(1,)]
    assert S.chunk_types("text") == ["text"] and S.chunk_types(["image", "table_row", "table_row"]) == ["table_row", "table_row"] and S.chunk_types(None) == []
    v = spark.createDataFrame([("a, b,c",), ("",), (None,), ("　x ,",)], "k string").select(S.split_values(F.col("k")).alias("v"))
    assert [r.v for r in v.collect()] == [["a", "b", "c"], [], [], ["x", ""]]
    with pytest.raises(ValueError):
        S.data_type("blob")


def test_pages_cover_everything(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "obj_id long")
    after, seen = None, []
    while True:
        got = S.page(df, after, 4).collect()
        seen += [r.obj_id for r in got]
        after = got[0].next_cursor if got else None
        if after is None:
            break
    assert seen == list(range(10))


def test_store(spark, tmp_path, as_rows):
    s = S.Store(spark, f"file://{tmp_path}/store")
    assert s.names() == [] and not s.drop("c") and s.create("c", {"doc_id": "text", "n": "int"}) and s.create("c", {}) and s.exists("c")
    with pytest.raises(ValueError):
        s.read("none")
    s.drop("c")
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "kb_id int, doc_id string, n int")
    one.write.partitionBy("kb_id").parquet(s._path("c"))
    new = spark.createDataFrame([(1, "a", 9), (1, "c", 8)], "kb_id int, doc_id string, n int")
    for _ in range(2):  # doing it again changes nothing
        s.replace_documents("c", new)
        assert as_rows(s.read("c"), "kb_id", "doc_id", "n") == [(1, "a", 9), (1, "b", 2), (1, "c", 8), (2, "a", 3)]
    assert as_rows(s.info("c"), "property", "objects")[0][1] == 4 and s.names() == ["c"]


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(999, None, 0)], "id long, vector array<float>, kind int").repartition(5)
    q = df.where("id % 100 = 0").withColumnRenamed("id", "qid")
    size = np.linalg.norm(v, axis=1)
    u = v / np.where(size > 0, size, 1)[:, None]
    for same in (None, "kind"):
        got = {}
        for r in R.vector_search(q, df, 7, same=same).collect():
            got.setdefault(r.qid, []).append((r.hit_rank, r.id))
        for i in (0, 100, 200):
            s = np.round(u @ u[i], 6)
            order = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if same is None or j % 3 == i % 3][:7]
            assert [j for _, j in sorted(got[i])] == order
    assert R.vector_search(q, df, 7, most=0.1).count() < 21 and R.vector_search(q.limit(0), df).count() == 0


def test_keyword_search(spark, as_rows):
    corpus = spark.createDataFrame([(1, "flow cost 合同期限", 1), (2, "flow flow", 1), (3, None, 1), (4, "flow", 2), (5, "", 1)], "id long, text string, kb_id int")
    q = spark.createDataFrame([(1, "Flow?", 1), (2, "期限", 1), (3, "zzz", 1), (4, None, 1), (5, "flow", 9)], "qid long, text string, kb_id int")
    assert as_rows(R.bm25_search(q, corpus, 5, part=["kb_id"]), "qid", "hit_rank", "id") == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    for a, b in ((q.limit(0), corpus), (q, corpus.limit(0)), (q.where("qid > 3 AND qid < 5"), corpus)):
        assert R.bm25_search(a, b, 5).count() == 0


def test_fusion(spark, as_rows):
    v = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.8)], "qid long, id long, score double")
    t = spark.createDataFrame([(1, 2, 3.0), (2, 5, 1.0)], "qid long, id long, score double")
    assert as_rows(R.hybrid_search(v, t, 5), "qid", "hit_rank", "id", "score") == [(1, 1, 2, 1.0), (1, 2, 1, 0.0), (2, 1, 5, 0.6)]


HITS = "qid long, hit_rank int, chunk_id string, chunk_type string, content string, score double"


def test_answers(spark, as_rows):
    rows = [(1, 1, "a", "text", "x" * 100 + "1", 0.5), (1, 2, "b", "text", "x" * 100 + "2", 0.9), (1, 3, "c", None, "y" * 501, 0.9), (1, 4, "c", None, "y" * 501, None), (2, 1, "d", "table_row", None, None)]
    hits = spark.createDataFrame(rows, HITS)
    m = A.merge_ranked(hits)
    assert as_rows(m, "qid", "merged_rank", "chunk_id") == [(1, 1, "c"), (1, 2, "a"), (2, 1, "d")]
    assert as_rows(A.within_budget(m, 550), "qid", "chunk_id") == [(1, "c"), (2, "d")] and as_rows(A.within_budget(m, 500), "qid") == [(2,)]
    cut = as_rows(A.response_sources(m), "qid", "merged_rank", "content", "chunk_type")
    assert cut[0] == (1, 1, "y" * 500 + "...", "text") and cut[2] == (2, 1, "", "table_row")
    chunks = spark.createDataFrame([("a", 1, "D", None, None, 3, "", "k1, k2"), ("d", 2, "E", "t1", 7, None, "desc", None)], "chunk_id string, obj_id long, doc_id string, table_id string, row_no int, paragraph_index int, description string, keywords string")
    got = {r.chunk_id: r.source for r in A.tagged(m, chunks).collect()}
    assert got["a"].startswith("[来源: D, 段落: 3]\n关键词: k1, k2\nxxx") and got["d"] == "[来源: E, 表格行: 7]\n描述: desc\n" and got["c"].startswith("[来源: 未知文件, 段落: 未知段落]\n")
    assert A.contexts(A.tagged(m.limit(0), chunks)).count() == 0


def test_outcomes(spark, as_rows):
    q = spark.createDataFrame([(1, "a?", 1, 8, 0.5), (1, "a?", 1, 8, 0.5), (2, " ", 1, 8, 0.5), (3, "b", 999, 8, None), (4, "c", 1, 8, None), (5, None, 1, 8, None)], "qid long, question string, kb_id int, k int, threshold double")
    ok = R.valid_questions(q, spark.createDataFrame([(1,)], "kb_id int"))
    ctx = spark.createDataFrame([(1, 2, "ctx"), (4, 1, "ctx")], "qid long, sources long, context string")
    got = A.answers(ok, ctx, lambda p: F.when(p.contains("a?"), "yes"))
    assert as_rows(got, "qid", "success", "error") == [(1, True, None), (2, False, "invalid question"), (3, False, "nothing found"), (4, False, "generation failed"), (5, False, "invalid question")]


def test_previews(spark):
    a = spark.createDataFrame([(1, 'see ```json\n{"images": [{"path": "p.jpg"}]}\n```', "p.jpg"), (2, "none", "q.png")], "qid long, answer string, image_path string")
    files = spark.createDataFrame([("p.jpg", bytearray(b"abc")), ("q.png", bytearray(b"x" * 50))], "path string, content binary")
    got = {r.qid: r for r in A.image_previews(a, files, 10).withColumn("j", A.json_block(F.col("answer"))).collect()}
    assert got[1].preview == "data:image/jpeg;base64,YWJj" and got[2].preview is None and got[1].j.startswith('{"images"') and got[2].j is None
