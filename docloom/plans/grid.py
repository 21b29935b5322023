"""Queries on tables: sheet blocks, headers, rendering; Word spans, votes and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import sql_shown, sql_strip
from docloom.operators import grid as G
from docloom.runtime import table, written

#: Words of merged header cells: the fixed ones, and the title ending of the test workbooks.
WORDS = (*G.MERGED_HEADER_WORDS, "表")
_K = "doc_id, sheet, table_id"
_B = f"{_K}, block_no"
_ON = "{a}.doc_id = {b}.doc_id AND {a}.sheet IS NOT DISTINCT FROM {b}.sheet AND {a}.table_id = {b}.table_id"


def _on(a: str, b: str, block: bool = False) -> str:
    return _ON.format(a=a, b=b) + (f" AND {a}.block_no = {b}.block_no" if block else "")


_CELLS = f"""g AS (SELECT {_K}, r, c, min(text) AS text, coalesce(max(grid_span), 1) AS grid_span, min(v_merge) AS v_merge FROM cells GROUP BY {_K}, r, c),
  m AS (SELECT DISTINCT doc_id, sheet, min_row, max_row, min_col, max_col FROM merges WHERE min_row <= max_row AND min_col <= max_col)"""
_ROWS = f"""xl AS (SELECT * FROM g WHERE sheet IS NOT NULL), rs AS (SELECT {_K}, r, max(text IS NOT NULL) AS has FROM xl GROUP BY {_K}, r),
  cover AS (SELECT rs.*, (SELECT count(*) FROM m WHERE m.doc_id = rs.doc_id AND m.sheet = rs.sheet AND rs.r + 1 BETWEEN m.min_row AND m.max_row) AS merges FROM rs)"""
_BLOCKS = f"""blk AS (SELECT *, min(r) OVER w AS start_row, max(r) OVER w AS end_row FROM (
    SELECT *, dense_rank() OVER (PARTITION BY {_K} ORDER BY island) AS block_no FROM (
      SELECT *, r - row_number() OVER (PARTITION BY {_K} ORDER BY r) AS island FROM cover WHERE has OR merges > 0))
    WINDOW w AS (PARTITION BY {_B})),
  colk AS (SELECT DISTINCT {_B.replace("doc_id", "b.doc_id").replace("sheet", "b.sheet").replace("table_id", "b.table_id").replace("block_no", "b.block_no")}, x.c
    FROM blk b JOIN xl x ON {_on("b", "x")} AND b.r = x.r WHERE x.text IS NOT NULL),
  hdr AS (SELECT {_B}, start_row, end_row, greatest(1, least(coalesce(min(CASE WHEN merges = 0 THEN r - start_row END), end_row - start_row + 1), 3))::INT AS header_rows
    FROM blk GROUP BY {_B}, start_row, end_row),
  fr AS (SELECT b.doc_id, b.sheet, b.table_id, b.block_no, b.start_row, b.r - b.start_row AS i, k.c, x.text, h.header_rows,
      row_number() OVER (PARTITION BY b.doc_id, b.sheet, b.table_id, b.block_no, b.r ORDER BY k.c) AS nc
    FROM blk b JOIN colk k ON {_on("b", "k", True)} JOIN hdr h ON {_on("b", "h", True)} LEFT JOIN xl x ON {_on("b", "x")} AND x.r = b.r AND x.c = k.c)"""
_HEADS = f"""span AS (SELECT x.*, (SELECT coalesce(max(max_col - min_col + 1), 1) FROM m WHERE m.doc_id = x.doc_id AND m.sheet IS NOT DISTINCT FROM x.sheet
      AND x.r + 1 BETWEEN m.min_row AND m.max_row AND x.c + 1 BETWEEN m.min_col AND m.max_col)::INT AS colspan FROM g x),
  hm AS (SELECT h.doc_id, h.sheet, h.table_id, h.block_no, s.r - h.start_row AS i, s.c, s.colspan, s.text FROM hdr h JOIN span s ON {_on("h", "s")}
    AND s.r BETWEEN h.start_row AND h.start_row + h.header_rows - 1 AND s.r <= h.end_row WHERE s.colspan > 1 AND regexp_matches(s.text, '{"|".join(WORDS)}')),
  parts AS (SELECT f.doc_id, f.sheet, f.table_id, f.block_no, f.c, f.nc, string_agg(CASE WHEN {sql_shown("f.text")} THEN f.text END, '/' ORDER BY i) AS p,
      list(f.text) AS texts FROM fr f WHERE i < header_rows GROUP BY ALL),
  par AS (SELECT p.*, (SELECT max_by(h.text, h.i * 100000 + h.c) FROM hm h WHERE {_on("h", "p", True)} AND p.c BETWEEN h.c AND h.c + h.colspan - 1) AS parent FROM parts p),
  hd AS (SELECT {_B}, c, nc, CASE WHEN parent IS NULL THEN coalesce(p, '') WHEN list_contains(texts, parent) THEN p ELSE concat_ws('/', parent, p) END AS h FROM par),
  heads AS (SELECT {_B}, list(h ORDER BY nc) AS header, string_agg(h, ' | ' ORDER BY nc) AS line, string_agg(CASE WHEN nc = 1 THEN '---' ELSE '---:' END, ' | ' ORDER BY nc) AS marks FROM hd GROUP BY {_B})"""
_XL = f"WITH {_CELLS}, {_ROWS}, {_BLOCKS}, {_HEADS}"
_MD = f"""lines AS (SELECT {_B}, i, header_rows, max(text IS NOT NULL) AS any_text, '| ' || string_agg(coalesce(text, '-'), ' | ' ORDER BY nc) || ' |' AS t FROM fr GROUP BY {_B}, i, header_rows),
  bodies AS (SELECT {_B}, string_agg(CASE WHEN i >= header_rows AND any_text THEN t END, chr(10) ORDER BY i) AS body FROM lines GROUP BY {_B}),
  md AS (SELECT h.*, concat_ws(chr(10), '| ' || line || ' |', '| ' || marks || ' |', body) AS markdown FROM heads h JOIN bodies b ON {_on("h", "b", True)})"""
_RES = f"""res0 AS (SELECT *, last_value(CASE WHEN grid_span > 1 THEN {{'c': c, 'grid_span': grid_span, 'text': text, 'v_merge': v_merge}} END IGNORE NULLS)
      OVER (PARTITION BY {_K}, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM g WHERE sheet IS NULL),
  res1 AS (SELECT doc_id, sheet, table_id, r, c, CASE WHEN k THEN o.grid_span ELSE grid_span END AS grid_span, CASE WHEN k THEN o.v_merge ELSE v_merge END AS v_merge,
      CASE WHEN k THEN o.text ELSE text END AS text FROM (SELECT *, o IS NOT NULL AND o.c + o.grid_span > c AS k FROM res0)),
  res AS (SELECT *, {sql_strip("coalesce(t0, '')")} AS t, dense_rank() OVER (PARTITION BY doc_id, table_id ORDER BY r) - 1 AS i FROM (
    SELECT *, CASE WHEN v_merge = 'continue' AND s IS NOT NULL THEN s.text ELSE text END AS t0 FROM (
      SELECT *, last_value(CASE WHEN v_merge = 'restart' THEN {{'text': text}} END IGNORE NULLS) OVER (PARTITION BY {_K}, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM res1)))"""
_TYPE = "CASE WHEN v_merge = 'restart' THEN CASE WHEN grid_span > 1 THEN 'both' ELSE 'vertical' END WHEN v_merge IS NOT NULL THEN 'merged' WHEN grid_span > 1 THEN 'horizontal' ELSE 'none' END"
_NUM = r"regexp_matches(translate({}, ',%+-', ''), '^\s*((\d+\.?\d*|\.\d+)([eE]\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$')"
_VOTES = f"""rw AS (SELECT doc_id, table_id, i, max(({_TYPE}) <> 'none') AS merged, max(coalesce(v_merge = 'restart', false)) AS starts,
      avg(regexp_matches(t, '{"|".join(G.HEADER_WORDS)}')::INT) AS words, avg({_NUM.format("t")}::INT) AS numbers, avg((t = '')::INT) AS blank FROM res GROUP BY doc_id, table_id, i),
  fails AS (SELECT doc_id, table_id, count(*) AS n, min(CASE WHEN starts THEN i END) AS st, min(CASE WHEN NOT merged THEN i END) AS fa,
      min(CASE WHEN NOT (words > 0.3 OR numbers < 0.3) THEN i END) AS fb, min(CASE WHEN NOT (merged OR blank < 0.5) THEN i END) AS fc FROM rw GROUP BY doc_id, table_id),
  v0 AS (SELECT doc_id, table_id, greatest(1, least(coalesce(fa, n), 3))::INT AS a, greatest(1, least(coalesce(fb, n), 3))::INT AS b,
      CASE WHEN coalesce(st < 3 AND st <= coalesce(fc, n), false) THEN NULL ELSE greatest(1, least(coalesce(fc, n), 3))::INT END AS c FROM fails),
  votes AS (SELECT *, CASE WHEN c IS NULL THEN greatest(a, b) WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE list_sort([a, b, c])[2] END AS header_rows FROM v0)"""
_WHEADS = """wc AS (SELECT r.doc_id, r.table_id, r.c, string_agg(CASE WHEN i < header_rows AND t <> '' THEN t END, '/' ORDER BY i) AS p,
      list(CASE WHEN i < header_rows AND t <> '' THEN t END) AS texts, coalesce(max(CASE WHEN i = 0 THEN t END), '') AS first FROM res r JOIN votes v ON r.doc_id = v.doc_id AND r.table_id = v.table_id GROUP BY r.doc_id, r.table_id, r.c),
  ww AS (SELECT doc_id, table_id, max(c) AS last FROM res WHERE i = 0 GROUP BY doc_id, table_id),
  st AS (SELECT doc_id, table_id, unnest(range(c, c + grid_span)) AS c, i, c AS c0, t FROM res WHERE v_merge = 'restart'),
  pr AS (SELECT doc_id, table_id, c, t, min(i * 100000 + c0) AS o, max(i * 100000 + c0) AS o2 FROM st GROUP BY doc_id, table_id, c, t),
  wp AS (SELECT w.*, (SELECT string_agg(t, '/' ORDER BY o DESC) FROM pr WHERE pr.doc_id = w.doc_id AND pr.table_id = w.table_id AND pr.c = w.c AND NOT list_contains(w.texts, pr.t)) AS fresh,
      (SELECT max_by(t, o2) FROM pr WHERE pr.doc_id = w.doc_id AND pr.table_id = w.table_id AND pr.c = w.c) AS lastp
    FROM wc w JOIN ww ON ww.doc_id = w.doc_id AND ww.table_id = w.table_id WHERE w.c <= ww.last),
  wh AS (SELECT doc_id, table_id, c, first, CASE WHEN p IS NOT NULL THEN concat_ws('/', fresh, p) ELSE coalesce(lastp, '') END AS h FROM wp),
  wv AS (SELECT doc_id, table_id, sum((h = '')::INT) <= count(*) * 0.5 AND NOT max(len(string_split(h, '/')) > 3) AS valid FROM wh GROUP BY doc_id, table_id),
  wheads AS (SELECT h.doc_id, h.table_id, valid, string_agg(CASE WHEN valid THEN h ELSE first END, ' | ' ORDER BY c) AS line,
      string_agg(CASE WHEN c = mc THEN '---' ELSE '---:' END, ' | ' ORDER BY c) AS marks FROM (SELECT *, min(c) OVER (PARTITION BY doc_id, table_id) AS mc FROM wh) h
      JOIN wv ON wv.doc_id = h.doc_id AND wv.table_id = h.table_id GROUP BY h.doc_id, h.table_id, valid)"""
_WORD = f"WITH {_CELLS}, {_RES}, {_VOTES}, {_WHEADS}"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return G.dedup(table(spark, d, "cells"))


def _excel(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).where("sheet IS NOT NULL")


def _word(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).where("sheet IS NULL")


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_cover(G.table_rows(_excel(spark, d)), table(spark, d, "merges"))


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return G.frames(G.table_blocks(_covered(spark, d)))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The block rows, written once as several steps read them, and the merged header cells."""
    frame = written(_frame(spark, d), "frames")
    return frame, G.header_merges(frame, _excel(spark, d), table(spark, d, "merges"), WORDS)


def row_merge_cover(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).select(*G.KEY, "r", "merges")


def table_islands(spark: SparkSession, d: str) -> DataFrame:
    return G.table_blocks(_covered(spark, d)).select(*G.BLOCK, "start_row", "end_row").distinct()


def drop_empty_cols(spark: SparkSession, d: str) -> DataFrame:
    x = _frame(spark, d).select(*G.BLOCK, "cols").distinct()
    return x.select(*G.BLOCK, F.posexplode("cols").alias("new_c", "c"))


def header_rows_merge(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d).select(*G.BLOCK, "header_rows").distinct()


def cell_colspan(spark: SparkSession, d: str) -> DataFrame:
    return G.cell_colspans(_excel(spark, d), table(spark, d, "merges"))


def header_merges(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d)[1]


def header_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return G.headers(*_parts(spark, d)).select(*G.BLOCK, F.array_join("header", " | ").alias("header"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    frame, merged = _parts(spark, d)
    return G.markdown_tables(frame, G.headers(frame, merged))


def table_html(spark: SparkSession, d: str) -> DataFrame:
    return G.html_tables(*_parts(spark, d))


def row_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.row_chunks(_frame(spark, d))


def merge_list(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_list(table(spark, d, "merges"))


def full_table_chunks(spark: SparkSession, d: str) -> DataFrame:
    frame, merged = _parts(spark, d)
    return G.full_tables(frame, G.headers(frame, merged), table(spark, d, "merges"))


def word_cell_spans(spark: SparkSession, d: str) -> DataFrame:
    return G.cell_spans(_word(spark, d))


def word_merged_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.cell_spans(_word(spark, d)).where("merge_type <> 'none'")


def numeric_test(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).where("text IS NOT NULL").select("text", G.numeric(F.col("text")).alias("is_numeric")).distinct()


def header_vote(spark: SparkSession, d: str) -> DataFrame:
    return G.header_votes(_word(spark, d))


def word_headers(spark: SparkSession, d: str) -> DataFrame:
    w = _word(spark, d)
    return G.word_headers(w, G.header_votes(w)).select("doc_id", "table_id", F.array_join("header", " | ").alias("header"), "valid")


def word_table_render(spark: SparkSession, d: str) -> DataFrame:
    w = _word(spark, d)
    votes = G.header_votes(w)
    return G.word_tables(w, votes, G.word_headers(w, votes))


QUERIES = {
    f.__name__: f
    for f in (
        row_merge_cover, table_islands, drop_empty_cols, header_rows_merge, cell_colspan, header_merges, header_hierarchy, table_markdown,
        table_html, row_chunks, merge_list, full_table_chunks, word_cell_spans, word_merged_cells, numeric_test, header_vote, word_headers, word_table_render,
    )
}
_JSON = "'{\"min_row\":' || min_row || ',\"max_row\":' || max_row || ',\"min_col\":' || min_col || ',\"max_col\":' || max_col || '}'"
_ML = f"ml AS (SELECT doc_id, sheet, '[' || string_agg({_JSON}, ',' ORDER BY min_row, min_col, max_row, max_col) || ']' AS merged_cells FROM m GROUP BY doc_id, sheet)"
_SPANS = f"""SELECT doc_id, table_id, r, c, {_TYPE} AS merge_type, (CASE WHEN v_merge = 'restart' THEN coalesce(stop, last + 1) - r WHEN v_merge IS NOT NULL THEN 0 ELSE 1 END)::INT AS rowspan, grid_span AS colspan FROM (
    SELECT *, min(CASE WHEN (v_merge IS NOT NULL AND v_merge <> 'continue') OR (v_merge IS NULL AND {sql_shown("text")}) THEN r END) OVER (PARTITION BY {_K}, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
      max(r) OVER (PARTITION BY {_K}, c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM g WHERE sheet IS NULL)"""
SQL = {
    "row_merge_cover": f"WITH {_CELLS}, {_ROWS} SELECT {_K}, r, merges FROM cover",
    "table_islands": f"{_XL} SELECT {_B}, start_row, end_row FROM hdr",
    "drop_empty_cols": f"{_XL} SELECT {_B}, c, (row_number() OVER (PARTITION BY {_B} ORDER BY c) - 1)::INT AS new_c FROM colk",
    "header_rows_merge": f"{_XL} SELECT {_B}, header_rows FROM hdr",
    "cell_colspan": f"{_XL} SELECT {_K}, r, c, text, colspan FROM span WHERE sheet IS NOT NULL",
    "header_merges": f"{_XL} SELECT {_B}, i, c, colspan, text FROM hm",
    "header_hierarchy": f"{_XL} SELECT {_B}, line AS header FROM heads",
    "table_markdown": f"{_XL}, {_MD} SELECT {_B}, markdown FROM md",
    "table_html": f"""{_XL}, cov AS (SELECT f.*, (SELECT max_by({{'c': h.c, 'colspan': h.colspan, 'text': h.text}}, h.i * 100000 + h.c) FROM hm h WHERE {_on("h", "f", True)} AND f.c BETWEEN h.c AND h.c + h.colspan - 1) AS k FROM fr f),
      tags AS (SELECT {_B}, i, nc, CASE WHEN i >= header_rows THEN '<td>' || coalesce(text, '-') || '</td>' WHEN k IS NULL THEN '<th>' || coalesce(text, '-') || '</th>'
        WHEN k.c = c THEN '<th colspan="' || k.colspan || '">' || k.text || '</th>' END AS t FROM cov),
      trs AS (SELECT {_B}, i, concat_ws(chr(10), '<tr>', string_agg(t, chr(10) ORDER BY nc), '</tr>') AS t FROM tags GROUP BY {_B}, i)
      SELECT {_B}, '<table border=''1''>' || chr(10) || string_agg(t, chr(10) ORDER BY i) || chr(10) || '</table>' AS html FROM trs GROUP BY {_B}""",
    "row_chunks": f"""{_XL}, ln AS (SELECT {_B}, start_row, i, header_rows, CASE WHEN max(text IS NOT NULL) THEN string_agg(coalesce(text, ''), ' | ' ORDER BY nc) ELSE '' END AS plain,
        '| ' || string_agg(CASE WHEN {sql_shown("text")} THEN text ELSE '-' END, ' | ' ORDER BY nc) || ' |' AS content,
        '<table border=''1''><tr><td>' || string_agg(coalesce(text, '-'), '</td><td>' ORDER BY nc) || '</td></tr></table>' AS html FROM fr GROUP BY {_B}, start_row, i, header_rows),
      w AS (SELECT *, lag(plain) OVER (PARTITION BY {_B} ORDER BY i) AS prev, lead(plain) OVER (PARTITION BY {_B} ORDER BY i) AS next FROM ln)
      SELECT {_B}, (start_row + i + 1)::INT AS row_no, content, html, '上一行：' || CASE WHEN i > header_rows THEN coalesce(prev, '') ELSE '' END || '。下一行：' || coalesce(next, '') AS context FROM w WHERE i >= header_rows""",
    "merge_list": f"WITH {_CELLS}, {_ML} SELECT * FROM ml",
    "full_table_chunks": f"""{_XL}, {_MD}, {_ML} SELECT md.doc_id, md.sheet, md.table_id, md.block_no, md.sheet || '_table_' || md.block_no AS chunk_table_id, start_row, end_row, header_rows,
      array_to_string(header, ', ') AS header, markdown AS content, '上一行：。下一行：' AS context, '表头: ' || to_json(header)::VARCHAR || ' 合并单元格: ' || coalesce(merged_cells, '[]') AS parent_table_info
      FROM md JOIN hdr ON {_on("md", "hdr", True)} LEFT JOIN ml ON ml.doc_id = md.doc_id AND ml.sheet = md.sheet""",
    "word_cell_spans": f"WITH {_CELLS} {_SPANS}",
    "word_merged_cells": f"WITH {_CELLS} SELECT * FROM ({_SPANS}) WHERE merge_type <> 'none'",
    "numeric_test": f"WITH {_CELLS} SELECT DISTINCT text, {_NUM.format('text')} AS is_numeric FROM g WHERE text IS NOT NULL",
    "header_vote": f"{_WORD} SELECT doc_id, table_id, a AS merge_vote, b AS content_vote, c AS structure_vote, header_rows FROM votes",
    "word_headers": f"{_WORD} SELECT doc_id, table_id, line AS header, valid FROM wheads",
    "word_table_render": f"""{_WORD}, wr AS (SELECT r.doc_id, r.table_id, i, max(t <> '') AS any_text, '| ' || string_agg(CASE WHEN t = '' THEN '-' ELSE t END, ' | ' ORDER BY r.c) || ' |' AS md, header_rows,
        CASE WHEN i < header_rows THEN '<tr><th>' || string_agg(CASE WHEN t = '' THEN '-' ELSE t END, '</th><th>' ORDER BY r.c) || '</th></tr>'
          ELSE '<tr><td>' || string_agg(CASE WHEN t = '' THEN '-' ELSE t END, '</td><td>' ORDER BY r.c) || '</td></tr>' END AS html
        FROM res r JOIN votes v ON v.doc_id = r.doc_id AND v.table_id = r.table_id GROUP BY r.doc_id, r.table_id, i, header_rows),
      wb AS (SELECT doc_id, table_id, string_agg(CASE WHEN i >= header_rows AND any_text THEN md END, chr(10) ORDER BY i) AS body, string_agg(html, chr(10) ORDER BY i) AS rows FROM wr GROUP BY doc_id, table_id)
      SELECT h.doc_id, h.table_id, concat_ws(chr(10), '| ' || line || ' |', '| ' || marks || ' |', body) AS markdown, '<table border=''1''>' || chr(10) || rows || chr(10) || '</table>' AS html
      FROM wheads h JOIN wb b ON b.doc_id = h.doc_id AND b.table_id = h.table_id""",
}
