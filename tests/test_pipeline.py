from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom import pipeline as P
from docloom.operators import segment as S
from docloom.operators.store import Store
from docloom.runtime import numbered
from docloom.sources import ooxml as X


def write_files(folder):
    folder.mkdir()
    table = [[("名称", 1, None), ("金额", 1, None)], [("甲", 1, None), ("12", 1, None)], [("乙", 1, None), ("7", 1, None)]]
    (folder / "a.docx").write_bytes(X.write_docx(["标题", "", "第一段。" * 200, table, ("尾段", ["rId1"]), ("", ["rId2", "rId1"])]))
    (folder / "b.xlsx").write_bytes(X.write_xlsx({"表1": ([(0, 0, "k"), (0, 1, "v"), (1, 0, "x"), (1, 1, "1"), (3, 0, "h"), (4, 0, "y")], [])}))
    (folder / "c.docx").write_bytes(b"broken")
    (folder / "d.pdf").write_bytes(b"%PDF")


def test_ingest_and_ask(spark, tmp_path, as_rows):
    write_files(tmp_path / "in")
    store = Store(spark, f"file://{tmp_path}/store")
    config = P.Config(S.FragmentConfig(), P.TableConfig(rows=True))
    for again in range(2):  # a second run replaces what the first stored
        report = P.ingest(spark, f"file://{tmp_path}/in", store, 1, config=config)
        got = {r.doc_id: r for r in report.collect()}
        assert got["c.docx"].error and got["d.pdf"].error == "unsupported file type" and got["a.docx"].error is None
        kept = store.read("chunks")
        a = as_rows(kept.where("doc_id = 'a.docx'"), "seq", "chunk_type", "is_fragment", "chunk_id")
        kinds = [r[1] for r in a]
        assert kinds == ["text", "text", "text", "table_full", "table_row", "table_row", "text", "image", "image"] and [r[0] for r in a] == list(range(9))
        assert [r[2] for r in a][:4] == [False, True, True, False] and a[3][3] == "a.docx_4"
        b = as_rows(kept.where("doc_id = 'b.xlsx'"), "seq", "chunk_type", "table_id", "row_no")
        assert b == [(0, "table_full", "表1_table_1", None), (1, "table_row", "表1_table_1", 2), (2, "table_full", "表1_table_2", None), (3, "table_row", "表1_table_2", 5)]
    assert kept.where("chunk_type = 'table_full' AND description <> ''").count() == 3
    q = spark.createDataFrame([(1, "标题 尾段", 1, 8, None), (2, "", 1, 8, None), (3, "标题", 9, 8, None), (4, "zzz", 1, 8, None)], "qid long, question string, kb_id int, k int, threshold double")
    assert as_rows(P.ask(q, kept), "qid", "success", "error") == [(1, True, None), (2, False, "invalid question"), (3, False, "nothing found"), (4, False, "nothing found")]


def test_html_tables(spark, tmp_path, as_rows):
    write_files(tmp_path / "in")
    files = X.files(spark, f"file://{tmp_path}/in")
    config = P.Config(tables=P.TableConfig("html"))
    got = P.excel_chunks(X.read_excel(files.where("doc_id = 'b.xlsx'")), config)
    assert all(r.content.startswith("<table border='1'>") for r in got.collect()) and got.count() == 2
    with pytest.raises(ValueError):
        P.TableConfig("pdf")


def test_numbered_in_stretches(spark, as_rows):
    rows = [("a", i % 97, i) for i in range(300)] + [("b", None, 1), (None, 5, 1), (None, 4, 2)]
    df = spark.createDataFrame(rows, "k string, m int, x int")
    got = {(r.k, r.m, r.x): r.n for r in numbered(df, ["k"], "m", ["x"], "n", width=10).collect()}
    want = sorted((m, x) for k, m, x in rows if k == "a")
    assert [got["a", m, x] for m, x in want] == list(range(1, 301)) and got["b", None, 1] == 1 and got[None, 4, 2] == 1 and got[None, 5, 1] == 2
    assert numbered(df.where(F.lit(False)), ["k"], "m", [], "n").count() == 0


def test_recreate_leaves_other_bases_alone(spark, tmp_path, as_rows):
    write_files(tmp_path / "in")
    store = Store(spark, f"file://{tmp_path}/store")
    for kb_id in (1, 2):
        P.ingest(spark, f"file://{tmp_path}/in", store, kb_id)
    before = as_rows(store.read("chunks", 2), "doc_id", "seq", "content")
    (tmp_path / "in" / "b.xlsx").unlink()
    P.ingest(spark, f"file://{tmp_path}/in", store, 1, recreate=True)
    assert store.bases("chunks") == [1, 2] and as_rows(store.read("chunks", 2), "doc_id", "seq", "content") == before
    assert {r.doc_id for r in store.read("chunks", 1).select("doc_id").distinct().collect()} == {"a.docx"}
    assert store.drop("chunks", 1) and not store.drop("chunks", 1) and not store.exists("chunks", 1) and store.exists("chunks", 2)


def test_replacing_a_document_leaves_other_files_alone(spark, tmp_path, as_rows):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("c", {"doc_id": "text", "n": "int"})
    for doc in ("a", "b", None):
        store.insert("c", spark.createDataFrame([(1, doc, 1), (1, doc, 2)], "kb_id int, doc_id string, n int"))
    files = lambda: set(store.read("c").inputFiles())
    before = files()
    batch = spark.createDataFrame([(1, "b", 7), (1, None, 8)], "kb_id int, doc_id string, n int")
    for _ in range(2):  # null names are replaced too, and again
        store.replace_documents("c", batch)
        assert as_rows(store.read("c"), "doc_id", "n") == [(None, 8), ("a", 1), ("a", 2), ("b", 7)]
    assert len(before & files()) == len(before) - 2


def test_fragments_and_pictures_in_the_flow(spark, tmp_path, as_rows):
    """Fragments name their siblings, pictures are analysed in their context, a failing picture gets the fallback."""
    from docloom.operators import enrich as E

    class Blind(E.Offline):
        def vision(self, prompts, images):
            if any(b"bad" in i for i in images):
                raise RuntimeError("unreadable")
            return E.Offline.vision(self, prompts, images)

    write_files(tmp_path / "in")
    word = X.read_word(X.files(spark, f"file://{tmp_path}/in").where("doc_id = 'a.docx'")).once()
    pictures = spark.createDataFrame([("a.docx", "rId1", bytearray(b"\x89PNG one")), ("a.docx", "rId2", bytearray(b"bad"))], "doc_id string, rel_id string, content binary")
    chunks = P.processed(word, X.read_excel(X.files(spark, f"file://{tmp_path}/none")), pictures, 1, make=Blind)
    about = [r.context for r in chunks.where("is_fragment").orderBy("seq").collect()]
    assert about[0].startswith(" 段落分片 1/2 同段落其他分片: 分片2: 第一段。") and about[1].startswith(" 段落分片 2/2 ")
    got = {r.rel_id: r for r in chunks.where("chunk_type = 'image'").collect()}
    assert got["rId1"].processing_status == "completed" and got["rId1"].keywords == "image/png" and got["rId1"].searchable_queries.startswith("文档标题")
    assert got["rId2"].processing_status == "failed" and got["rId2"].image_type == "unknown" and all(r.vector for r in got.values())


def test_attachments_lose_no_picture(spark, tmp_path):
    cell = lambda t, *pics: (t, 1, None, list(pics))
    table = [[cell("名称", "rId1"), cell("金额")], [cell("甲"), cell("12", "rId2", "rId3")], [cell("乙"), cell("7")]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(X.write_docx([("文", ["rId4"]), table]))
    word = X.read_word(X.files(spark, f"file://{tmp_path}/in")).once()
    want = {
        ("separate_block", True): [("image", "rId1"), ("image", "rId2"), ("image", "rId3"), ("image", "rId4")],
        ("merge_into_row", True): [("image", "rId1"), ("image", "rId4"), ("table_row", "rId2,rId3")],
        ("merge_into_row", False): [("image", "rId1"), ("image", "rId2"), ("image", "rId3"), ("image", "rId4")],
        ("merge_into_table", False): [("image", "rId4"), ("table_full", "rId1,rId2,rId3")],
    }
    for (mode, rows), expected in want.items():
        got = P.word_chunks(word, P.Config(tables=P.TableConfig(rows=rows), images=P.ImageConfig(mode))).where("rel_id IS NOT NULL OR images IS NOT NULL")
        assert sorted((r.chunk_type, r.rel_id or r.images) for r in got.collect()) == expected
    with pytest.raises(ValueError):
        P.ImageConfig("elsewhere")


def test_older_word_files_go_through_the_converter(spark, tmp_path, as_rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0 old")
    files, new = X.files(spark, f"file://{tmp_path}/in"), X.write_docx(["文"])
    assert as_rows(X.read_word(files, lambda data: new).blocks(), "text") == [("文",)] and X.read_word(files).errors().count() == 1
