from __future__ import annotations

import pytest

from docloom.operators import segment as S


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("abcd。efghijklmn", 10, 3, [(0, 5), (5, 15)]),
        ("abcdefghijklmno", 10, 3, [(0, 15)]),
        ("a" * 700, 500, 50, [(0, 500), (450, 700)]),
        ("a" * 490 + "," + "a" * 300, 500, 50, [(0, 491), (491, 791)]),
        ("a" * 599 + "。" + "b" * 50, 500, 50, [(0, 600), (600, 650)]),
        ("a" * 500 + " " + "b" * 200, 500, 50, [(0, 501), (501, 701)]),
        ("a" * 480 + "," + "a" * 18 + "。" + "b" * 30 + " " + "c" * 300, 500, 50, [(0, 531), (500, 831)]),
        ("", 10, 3, []),
        ("short", 10, 3, [(0, 5)]),
    ],
)
def test_spans(text, size, overlap, want):
    assert S.spans(text, size, overlap) == want


@pytest.mark.parametrize("bad", [{"size": 0}, {"overlap": -1}, {"overlap": 500}, {"least": 0}, {"least": 500}])
def test_config(bad):
    with pytest.raises(ValueError):
        S.FragmentConfig(**bad)


def test_paragraphs(spark, as_rows):
    df = spark.createDataFrame([(1, "p1\n\n　 \np2"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    assert as_rows(S.paragraphs(df, "doc_id", "text")) == [(1, 1, "p1", "上一段：。下一段：p2"), (1, 2, "p2", "上一段：p1。下一段："), (4, 1, "x", "上一段：。下一段：")]


CHUNK = "doc_id string, seq int, obj_id long, paragraph_index int, chunk_type string, content string, is_fragment boolean"


def test_fragments(spark, as_rows):
    long = "a" * 480 + "。" + "b" * 400 + "。" + "c" * 30
    rows = [("d", 0, 1, 1, "text", long, False), ("d", 1, 2, 2, "text", "short", None), ("d", 2, 3, None, "table_full", long, None), ("d", 3, 4, 3, "text", None, False), ("d", 4, 5, 4, "text", long, True)]
    df = spark.createDataFrame(rows, CHUNK)
    cut = S.fragments(df)
    assert as_rows(cut, "obj_id", "fragment_index", "total_fragments", "start_pos", "end_pos") == [(1, 1, 2, 0, 481), (1, 2, 2, 481, 912)]
    out = S.with_fragments(df)
    assert as_rows(out, "position", "obj_id", "chunk_id")[:3] == [(1, 1, "d_1"), (2, 1, "d_2"), (3, 2, "d_3")]
    assert as_rows(S.fragment_stats(out)) == [("d", 6, 3, 3, 1)]
    assert as_rows(S.position_map(out), "obj_id", "positions")[0] == (1, "1,2")
    assert as_rows(S.sibling_context(cut))[0][2].startswith(" 段落分片 1/2 同段落其他分片: 分片2: bbb")
    assert S.with_fragments(df.limit(0)).count() == 0


def test_tables(spark, as_rows):
    rows = [("d", 0, "paragraph", "a", None), ("d", 1, "paragraph", "", None), ("d", 2, "table", None, 1), ("d", 2, "table", None, 1), ("d", 3, "paragraph", "b", None), ("e", 0, "table", None, 1)]
    t = S.table_neighbours(spark.createDataFrame(rows, "doc_id string, block_pos int, kind string, text string, table_no int"))
    assert as_rows(t, "doc_id", "preceding_index", "following_index", "context") == [("d", 1, 2, "上一段：a。下一段：b"), ("e", None, None, "上一段：。下一段：")]
