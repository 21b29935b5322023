from __future__ import annotations

import pytest

from docloom.operators import grid as G

CELLS = "doc_id string, sheet string, table_id string, r int, c int, text string, grid_span int, v_merge string"
MERGES = "doc_id string, sheet string, min_row int, max_row int, min_col int, max_col int"


def cells(spark, grid, sheet="s", spans=None):
    rows = [("d", sheet, "t", r, c, v, *(spans or {}).get((r, c), (1, None))) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return G.dedup(spark.createDataFrame(rows + rows[:1], CELLS))


def frame(spark, grid, merges=()):
    m = spark.createDataFrame([("d", "s", *x) for x in merges], MERGES)
    x = cells(spark, grid)
    f = G.frames(G.table_blocks(G.merge_cover(G.table_rows(x), m)))
    return x, m, f


def test_islands(spark, as_rows):
    grid = [["a"], ["b"], [None], ["c"]]
    _, _, f = frame(spark, grid)
    assert as_rows(f.select("block_no", "start_row", "end_row").distinct()) == [(1, 0, 1), (2, 3, 3)]
    _, _, f = frame(spark, grid, [(3, 3, 1, 1)])
    assert as_rows(f.select("block_no", "start_row", "end_row").distinct()) == [(1, 0, 3)]


def test_markdown_and_html(spark, as_rows):
    x, m, f = frame(spark, [["a", None, "b"], ["1", None, None], [None, None, None]], [(3, 3, 1, 1)])
    heads = G.headers(f, G.header_merges(f, x, m))
    assert as_rows(G.markdown_tables(f, heads), "markdown") == [("| a | b |\n| --- | ---: |\n| 1 | - |",)]
    got = as_rows(G.row_chunks(f), "row_no", "content", "html", "context")
    assert got[0] == (2, "| 1 | - |", "<table border='1'><tr><td>1</td><td>-</td></tr></table>", "上一行：。下一行：")


def test_merged_header(spark, as_rows):
    x, m, f = frame(spark, [["净利润", None, "k"], ["p", "q", None], ["1", "2", "3"]], [(1, 1, 1, 2), (2, 2, 3, 3)])
    merged = G.header_merges(f, x, m)
    assert as_rows(G.headers(f, merged), "header") == [(["净利润/p", "净利润/q", "k"],)]
    html = as_rows(G.html_tables(f, merged), "html")[0][0]
    assert html.count('<th colspan="2">净利润</th>') == 2 and "<td>3</td>" in html


@pytest.mark.parametrize(
    ("grid", "spans", "want"),
    [
        ([["年度", "学校", "人数"], ["2005", "X", "110"]], {}, (1, 1, 2, 1)),
        ([["x", "y"], ["p", "q"], ["u", "v"]], {}, (1, 3, 3, 3)),
        ([["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"]], {}, (1, 1, 3, 1)),
        ([["a", "b"], ["c", "d"], ["1", "2"]], {(0, 0): (1, "restart"), (1, 0): (1, "continue")}, (2, 2, None, 2)),
    ],
)
def test_votes(spark, as_rows, grid, spans, want):
    v = G.header_votes(cells(spark, grid, None, spans))
    assert as_rows(v, "merge_vote", "content_vote", "structure_vote", "header_rows") == [want]


def test_numeric(spark):
    df = spark.createDataFrame([(t,) for t in ("-5%", "1,234", "-", "", "nan", None, "12a")], "t string")
    assert [r[0] for r in df.select(G.numeric(df.t)).collect()] == [True, True, False, False, True, False, False]


def test_word_spans(spark, as_rows):
    x = cells(spark, [["T", None], ["a", "b"], ["a", "c"]], None, {(0, 0): (2, None), (1, 0): (1, "restart"), (2, 0): (1, "continue")})
    got = as_rows(G.cell_spans(x), "r", "c", "merge_type", "rowspan", "colspan")
    assert got[0] == (0, 0, "horizontal", 1, 2) and got[2] == (1, 0, "vertical", 2, 1) and got[4] == (2, 0, "merged", 0, 1)
    assert as_rows(G.word_headers(x, G.header_votes(x)), "valid")


def test_empty(spark):
    none = spark.createDataFrame([], CELLS)
    m = spark.createDataFrame([], MERGES)
    f = G.frames(G.table_blocks(G.merge_cover(G.table_rows(G.dedup(none)), m)))
    assert G.headers(f, G.header_merges(f, none, m)).count() == 0 and G.header_votes(G.dedup(none)).count() == 0
