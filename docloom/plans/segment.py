"""Segmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import sql_shown, sql_strip
from docloom.operators import segment as S
from docloom.runtime import table

SIZE, OVERLAP, LEAST = 500, 50, 100
_M3, _M2, _M1 = "[\\n。！？)）!?]", "[;；…:：]", "[,，\\t .]"


def _best(window: str) -> str:
    """SQL: length of the window up to the last mark of the best rank, or null."""
    return "coalesce(" + ", ".join(f"nullif(length(regexp_extract({window}, '(?s)^.*{m}')), 0)" for m in (_M3, _M2, _M1)) + ")"


def chunker_sql(source: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """Recursive CTEs ending in pieces(id, chunk_no, start_pos, end_pos, content) over ``source`` (id, text)."""
    window = "substr(text, greatest(want - 100, s)::BIGINT + 1, (least(want + 100, n) - greatest(want - 100, s))::BIGINT)"
    tail = f"substr(text, greatest(cut - {overlap}, s)::BIGINT + 1, (cut - greatest(cut - {overlap}, s))::BIGINT)"
    return rf"""src AS ({source}),
    walk(id, s, cut) AS (
      SELECT id, 0::BIGINT, NULL::BIGINT FROM src WHERE length(text) > 0
      UNION ALL
      SELECT id, CASE WHEN again <= s THEN cut ELSE again END, cut FROM (
        SELECT id, s, cut, n, CASE WHEN t IS NULL THEN cut - {overlap} ELSE greatest(cut - {overlap}, s) + t END AS again FROM (
          SELECT *, {_best(tail)} AS t FROM ({{cuts}})) WHERE cut < n)
    ),
    """.replace("{cuts}", _cuts("walk", size, window)) + f"""
    cuts AS ({_cuts("walk", size, window)}),
    pieces AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY s)::INT AS chunk_no, s::INT AS start_pos, cut::INT AS end_pos,
      substr(text, s + 1, cut - s) AS content FROM cuts WHERE n <= {size} OR {sql_shown("substr(text, s + 1, cut - s)")})"""


def _cuts(walk: str, size: int, window: str) -> str:
    return rf"""
      SELECT id, text, n, s, CASE WHEN want >= n THEN n
          WHEN m IS NOT NULL AND greatest(want - 100, s) + m <> want THEN greatest(want - 100, s) + m
          WHEN f > 0 THEN want + f WHEN want + 100 >= n THEN n ELSE want END AS cut FROM (
        SELECT *, CASE WHEN want < n THEN {_best(window)} END AS m,
          CASE WHEN want < n THEN length(regexp_extract(substr(text, want + 1, 100), '(?s)^.*?[\s\p{{Z}}\x0b\x1c-\x1f\x85]')) END AS f FROM (
          SELECT w.id, w.s, src.text, length(src.text) AS n, least(w.s + {size}, length(src.text)) AS want FROM {walk} w JOIN src ON src.id = w.id))"""


_LONG = f"SELECT obj_id AS id, min(content) AS text FROM chunk WHERE chunk_type = 'text' AND length(content) > {SIZE} AND NOT coalesce(is_fragment, false) GROUP BY obj_id"
_FRAGS = f"""frags AS (SELECT p.id AS obj_id, row_number() OVER (PARTITION BY p.id ORDER BY chunk_no)::INT AS fragment_index,
  count(*) OVER (PARTITION BY p.id)::INT AS total_fragments, start_pos, end_pos, (instr(src.text, content) - 1)::INT AS fragment_start_pos,
  (instr(src.text, content) - 1 + length(content))::INT AS fragment_end_pos, content
  FROM pieces p JOIN src ON src.id = p.id WHERE length({sql_strip("content")}) >= {LEAST})"""
_FRAG_CTES = f"WITH RECURSIVE {chunker_sql(_LONG)}, {_FRAGS}"
_EXPANDED = """expanded AS (SELECT doc_id, seq, obj_id, paragraph_index, chunk_type, was OR piece IS NOT NULL AS is_fragment, fragment_index, total_fragments,
  coalesce(piece, content) AS content, row_number() OVER (PARTITION BY doc_id ORDER BY seq, obj_id, fragment_index)::INT AS position FROM (
  SELECT c.doc_id, c.seq, c.obj_id, c.paragraph_index, c.chunk_type, c.content, coalesce(c.is_fragment, false) AS was, f.fragment_index, f.total_fragments, f.content AS piece
  FROM chunk c LEFT JOIN frags f ON f.obj_id = c.obj_id))"""
_PARAS = f"""paras AS (SELECT doc_id, block_pos, content, row_number() OVER (PARTITION BY doc_id ORDER BY block_pos)::INT AS paragraph_index FROM (
  SELECT doc_id, block_pos, min(text) AS content FROM blocks WHERE kind = 'paragraph' AND {sql_shown("text")} GROUP BY doc_id, block_pos))"""
_TABLES = f"""tabs AS (SELECT * FROM (SELECT doc_id, block_pos, kind, table_no,
    sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_pos) AS before,
    last_value(CASE WHEN p THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS preceding,
    first_value(CASE WHEN p THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following
  FROM (SELECT *, kind = 'paragraph' AND {sql_shown("text")} AS p FROM (
    SELECT doc_id, block_pos, min(kind) AS kind, min(text) AS text, min(table_no) AS table_no FROM blocks GROUP BY doc_id, block_pos))) WHERE kind = 'table')"""
_DOC_PARAS = f"""dp AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS paragraph_index FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL) WHERE {sql_shown("content")})"""


def _chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk")


def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "paragraph_index", "content")


def paragraph_context(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "paragraph_index", "context")


def body_paragraph_index(spark: SparkSession, d: str) -> DataFrame:
    return S.body_paragraphs(table(spark, d, "blocks"))


def paragraph_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = _chunk(spark, d).where("chunk_type = 'text' AND paragraph_index IS NOT NULL").select("doc_id", "paragraph_index").distinct()
    return S.lookup_paragraph(S.body_paragraphs(table(spark, d, "blocks")), asked)


def should_fragment(spark: SparkSession, d: str) -> DataFrame:
    return _chunk(spark, d).select("obj_id", F.coalesce(S.should_fragment(S.FragmentConfig()), F.lit(False)).alias("should_fragment"))


def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_split(table(spark, d, "documents"), "doc_id", "text", SIZE, OVERLAP)


def fragment_expand(spark: SparkSession, d: str) -> DataFrame:
    return S.fragments(_chunk(spark, d))


def fragment_sibling_context(spark: SparkSession, d: str) -> DataFrame:
    return S.sibling_context(S.fragments(_chunk(spark, d)))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.with_fragments(_chunk(spark, d)).select("doc_id", "obj_id", "position", "chunk_id", "is_fragment", "content")


def position_map(spark: SparkSession, d: str) -> DataFrame:
    return S.position_map(S.with_fragments(_chunk(spark, d)))


def fragment_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.fragment_stats(S.with_fragments(_chunk(spark, d)))


def table_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return S.table_neighbours(table(spark, d, "blocks"))


def table_fragment_context(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks")
    return S.table_fragment_context(S.table_neighbours(blocks), S.body_paragraphs(blocks))


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_split, paragraph_context, body_paragraph_index, paragraph_lookup, should_fragment, chunk_split, fragment_expand,
        fragment_sibling_context, chunk_ids, position_map, fragment_stats, table_neighbours, table_fragment_context,
    )
}
SQL = {
    "paragraph_split": f"WITH {_DOC_PARAS} SELECT doc_id, paragraph_index::INT AS paragraph_index, content FROM dp",
    "paragraph_context": f"""WITH {_DOC_PARAS} SELECT doc_id, paragraph_index::INT AS paragraph_index, '上一段：' || coalesce(lag(content) OVER w, '') || '。下一段：' || coalesce(lead(content) OVER w, '') AS context
      FROM dp WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index)""",
    "body_paragraph_index": f"WITH {_PARAS} SELECT * FROM paras",
    "paragraph_lookup": f"""WITH {_PARAS}, asked AS (SELECT DISTINCT doc_id, paragraph_index FROM chunk WHERE chunk_type = 'text' AND paragraph_index IS NOT NULL)
      SELECT a.doc_id, a.paragraph_index, p.content FROM asked a LEFT JOIN paras p ON p.doc_id = a.doc_id AND p.paragraph_index = a.paragraph_index""",
    "should_fragment": f"SELECT obj_id, coalesce(chunk_type = 'text' AND length(content) > {SIZE} AND NOT coalesce(is_fragment, false), false) AS should_fragment FROM chunk",
    "chunk_split": f"WITH RECURSIVE {chunker_sql('SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL')} SELECT id AS doc_id, chunk_no, start_pos, end_pos, content FROM pieces",
    "fragment_expand": f"{_FRAG_CTES} SELECT * FROM frags",
    "fragment_sibling_context": f"""{_FRAG_CTES} SELECT a.obj_id, a.fragment_index, ' 段落分片 ' || a.fragment_index || '/' || a.total_fragments || ' ' ||
        coalesce('同段落其他分片: ' || string_agg('分片' || b.fragment_index || ': ' || substr(b.content, 1, 50) || '...', '; ' ORDER BY b.fragment_index), '') AS context
      FROM frags a LEFT JOIN frags b ON b.obj_id = a.obj_id AND b.fragment_index <> a.fragment_index GROUP BY a.obj_id, a.fragment_index, a.total_fragments""",
    "chunk_ids": f"{_FRAG_CTES}, {_EXPANDED} SELECT doc_id, obj_id, position, doc_id || '_' || position AS chunk_id, is_fragment, content FROM expanded",
    "position_map": f"""{_FRAG_CTES}, {_EXPANDED} SELECT doc_id, seq, obj_id, min(position) AS first_position, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
      FROM expanded GROUP BY doc_id, seq, obj_id""",
    "fragment_stats": f"""{_FRAG_CTES}, {_EXPANDED} SELECT doc_id, count(*) AS total_chunks, count_if(NOT is_fragment) AS originals, count_if(is_fragment) AS fragments,
      count(DISTINCT CASE WHEN fragment_index IS NOT NULL THEN obj_id END) AS fragmented_rows FROM expanded GROUP BY doc_id""",
    "table_neighbours": f"""WITH {_TABLES} SELECT doc_id, block_pos, table_no, (CASE WHEN before > 0 THEN before END)::BIGINT AS preceding_index,
      (CASE WHEN following IS NOT NULL THEN before + 1 END)::BIGINT AS following_index, preceding, following,
      '上一段：' || coalesce(preceding, '') || '。下一段：' || coalesce(following, '') AS context FROM tabs""",
    "table_fragment_context": "WITH RECURSIVE " + chunker_sql(f"WITH {_PARAS} SELECT doc_id || chr(0) || paragraph_index AS id, content AS text FROM paras WHERE length(content) > {SIZE}") + f""",
      {_FRAGS}, {_PARAS}, {_TABLES}, whole AS (SELECT obj_id, string_agg('[分片' || fragment_index || '] ' || content, ' ' ORDER BY fragment_index) AS joined FROM frags GROUP BY obj_id),
      texts AS (SELECT p.doc_id, p.paragraph_index, coalesce(w.joined, p.content) AS t FROM paras p LEFT JOIN whole w ON w.obj_id = p.doc_id || chr(0) || p.paragraph_index)
      SELECT t.doc_id, t.block_pos, '上一段：' || coalesce(a.t, '') || '。下一段：' || coalesce(b.t, '') AS context FROM tabs t
      LEFT JOIN texts a ON a.doc_id = t.doc_id AND a.paragraph_index = t.before LEFT JOIN texts b ON b.doc_id = t.doc_id AND b.paragraph_index = t.before + 1 AND t.following IS NOT NULL""",
}
