from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import config
from docloom.operators import enrich as E
from docloom.operators import images as I
from docloom.operators.store import Store
from docloom.sources import ooxml as X
from docloom.streaming import ingest


def test_docx():
    data = X.write_docx(["a\tb\nc<&>", "", [[("h", 2, None)], [("x", 1, "restart"), ("y\nz", 1, None)], [("", 1, "continue"), ("w", 1, None)]], ("pic", ["rId1", "rId2"])])
    blocks, cells, images = X.parse_docx(data)
    assert blocks == [(0, "paragraph", "a\tb\nc<&>", None), (1, "paragraph", "", None), (2, "table", None, 1), (3, "paragraph", "pic", None)]
    assert cells == [(1, 0, 0, "h", 2, None), (1, 0, 1, None, 1, None), (1, 1, 0, "x", 1, "restart"), (1, 1, 1, "y\nz", 1, None), (1, 2, 0, "", 1, "continue"), (1, 2, 1, "w", 1, None)]
    assert images == [(3, None, None, 0, "rId1"), (3, None, None, 1, "rId2")]


def test_xlsx():
    data = X.write_xlsx({"S & 1": ([(0, 0, "a"), (1, 27, "b"), (1, 2, "a")], [(1, 2, 1, 3)]), "空": ([], [])})
    assert X.parse_xlsx(data) == ([("S & 1", 0, 0, "a"), ("S & 1", 1, 2, "a"), ("S & 1", 1, 27, "b")], [("S & 1", 1, 2, 1, 3)])


def test_xlsx_numbers_and_dates():
    base = X.write_xlsx({"s": ([(0, 0, "x")], [])})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            text = a.read(n).decode()
            if n.endswith("sheet1.xml"):
                extra = '<c r="B1"><v>12.0</v></c><c r="C1"><v>1.5</v></c><c r="D1" s="1"><v>45000</v></c><c r="E1" t="b"><v>1</v></c><c r="F1" t="inlineStr"><is><t>in</t></is></c><c r="G1"/>'
                text = text.replace("</row>", extra + "</row>")
            b.writestr(n, text)
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        b.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    assert [c[3] for c in X.parse_xlsx(out.getvalue())[0]] == ["x", "12", "1.5", "2023-03-15", "True", "in"]


def test_files(spark, tmp_path, as_rows):
    (tmp_path / "a.docx").write_bytes(X.write_docx(["one"]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "b.xlsx").write_bytes(X.write_xlsx({"s": ([(0, 0, "v")], [])}))
    p = X.read_word(X.files(spark, f"file://{tmp_path}", "*.docx"))
    assert as_rows(p.blocks()) == [("a.docx", 0, "paragraph", "one", None)] and as_rows(p.errors(), "doc_id") == [("bad.docx",)]
    assert as_rows(X.read_excel(X.files(spark, f"file://{tmp_path}", "*.xlsx")).cells(), "doc_id", "text", "table_id") == [("b.xlsx", "v", "table_1")]
    assert X.files(spark, f"file://{tmp_path}", "*.none").count() == 0
    kinds = spark.createDataFrame([("x/A.DOC",), ("b.xlsx",), ("c.pdf",), ("d",)], "p string")
    assert [r[0] for r in kinds.select(X.document_kind(F.col("p"))).collect()] == ["word", "excel", "unsupported", "unsupported"]


def test_media(spark, tmp_path, as_rows):
    base = X.write_docx([("p", ["rId1"])])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as a, zipfile.ZipFile(out, "w") as b:
        b.writestr("word/document.xml", a.read("word/document.xml"))
        b.writestr("word/media/i.png", b"\x89PNG123")
        rel = '<Relationship Id="rId1" Target="media/i.png"/><Relationship Id="rId2" Target="styles.xml"/>'
        b.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"bad"))], "doc_id string, content binary")
    got = X.save_media(X.media(df), f"file://{tmp_path}/img").collect()
    assert [(r.doc_id, r.rel_id) for r in got] == [("a.docx", "rId1")] and open(got[0].path, "rb").read() == b"\x89PNG123" and got[0].path.endswith(".png")
    assert X.files(spark, f"file://{tmp_path}/missing").count() == 0


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"chunker": {"size": 7}, "key": "${A}-${NONE}", "l": ["${A}"]}')
    got = config.load(str(f), {"A": "x"})
    assert got["chunker"] == {"size": 7, "overlap": 50, "least": 100} and got["key"] == "x-${NONE}" and got["l"] == ["x"]
    assert config.load(None) == config.DEFAULTS


def test_images(spark, as_rows):
    refs = spark.createDataFrame([("d", 1, None, None, 0, "r1"), ("d", 3, 0, 1, 0, "r1"), ("d", 3, 0, 1, 1, "r2"), ("d", 0, None, None, 0, None)], "doc_id string, block_pos int, r int, c int, ord int, rel_id string")
    blocks = spark.createDataFrame([("d", 0, "paragraph", ""), ("d", 1, "paragraph", " "), ("d", 3, "table", None)], "doc_id string, block_pos int, kind string, text string")
    a = I.anchored(I.first_seen(refs), blocks)
    assert as_rows(a, "rel_id", "image_index", "container_type", "paragraph_index", "row_no") == [("r1", 0, "paragraph", 1, None), ("r2", 1, "table_cell", None, 1)]
    assert as_rows(I.attached(a, "merge_into_row"), "row_no", "images") == [(1, "r2")] and I.attached(a, "separate_block").count() == 1


def test_image_context(spark, as_rows):
    rows = [("d", 0, 1, "text", "长句。"), ("d", 1, 2, "text", "标题"), ("d", 2, 3, "image", "p.png"), ("d", 3, 4, "table_full", "t"), ("d", 4, 5, "text", "后"), ("e", 0, 6, "image", "q.png")]
    got = as_rows(I.image_context(spark.createDataFrame(rows, "doc_id string, seq int, obj_id long, chunk_type string, content string")), "obj_id", "context")
    assert got == [(3, "文档标题：标题，前文：长句。 标题，后文：后，图片位置：第3个内容块"), (6, "文档标题：未知文档，图片位置：第1个内容块")]


def test_analysis(spark):
    rows = [('{"description": "d", "keywords": "x", "searchable_queries": [" q ", "q", ""]}',), ("no json",), (None,)]
    df = spark.createDataFrame(rows, "response string").withColumn("n", F.monotonically_increasing_id())
    got = [r for r in I.analysed(df, F.col("response")).orderBy("n").collect()]
    assert [r.processing_status for r in got] == ["completed", "failed", "failed"]
    assert got[0].analysis.searchable_queries == ["q"] or got[0].analysis.description in ("d", "") and got[1].analysis.image_type == "unknown"


def test_salvage(spark):
    rows = [('xx {"description":"d","keywords":["k"]} yy',), ('{"description":"e"}',), ("nothing",), (None,), ("{broken",)]
    got = [r.s for r in spark.createDataFrame(rows, "r string").select(E.salvaged(F.col("r")).alias("s")).collect()]
    assert [(s.description, s.keywords) for s in got] == [("d", ["k"]), ("e", []), ("", []), ("", []), ("", [])]


def test_embedding_text(spark):
    rows = [("table_full", "c", "d", "x, y", None), ("table_row", "c", None, "", None), ("image", "p", None, None, "f.png"), ("image", "p", "d", "k", None), ("text", "c", "d", None, None), ("image", None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "chunk_type string, content string, description string, keywords string, original_filename string").select(E.embedding_text()).collect()]
    assert got == ["d\nx, y", "c", "图片文件：f.png", "图片描述：d\n关键词：k", "c\nd", "图片内容"]


class Failing(E.Offline):
    def complete(self, prompts):
        raise ConnectionError


def test_providers(spark, monkeypatch):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    pauses = []
    assert E.with_retry(flaky, sleep=pauses.append) == "ok" and pauses == [4.0, 8.0]
    with pytest.raises(ValueError):
        E.with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=pauses.append)
    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "obj_id long, t string")
    got = {r.obj_id: r.result for r in E.call_model(df, "obj_id", F.col("t"), method="embed").collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_stream_replaces_documents(spark, tmp_path, as_rows):
    store = Store(spark, f"file://{tmp_path}/store")
    first = spark.createDataFrame([(1, "a", "old"), (1, "b", "x")], "kb_id int, doc_id string, content string")
    first.write.partitionBy("kb_id").parquet(store._path("c"))
    spark.createDataFrame([(1, "a", "new")], "kb_id int, doc_id string, content string").write.parquet(f"{tmp_path}/in")
    for state in ("s1", "s2"):  # a replay from the start gives the same table
        ingest.replace_stream(ingest.read_files(spark, f"file://{tmp_path}/in"), store, "c", f"file://{tmp_path}/{state}").awaitTermination()
        assert as_rows(store.read("c"), "doc_id", "content") == [("a", "new"), ("b", "x")]
