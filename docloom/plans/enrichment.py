"""Queries on images, prompts, model output and embedding texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import sql_shown, sql_strip
from docloom.operators import answer as A
from docloom.operators import enrich as E
from docloom.operators import images as I
from docloom.operators import store as S
from docloom.runtime import table


def _chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk")


def _images(spark: SparkSession, d: str) -> DataFrame:
    return I.anchored(I.first_seen(table(spark, d, "image_refs")), table(spark, d, "blocks"))


def first_seen_images(spark: SparkSession, d: str) -> DataFrame:
    return I.first_seen(table(spark, d, "image_refs")).select("doc_id", "rel_id", "block_pos", "image_index")


def image_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d)


def image_attach(spark: SparkSession, d: str) -> DataFrame:
    return I.attached(_images(spark, d), "merge_into_table")


def doc_title(spark: SparkSession, d: str) -> DataFrame:
    return I.doc_titles(_chunk(spark, d))


def image_window_context(spark: SparkSession, d: str) -> DataFrame:
    return I.image_context(_chunk(spark, d))


def _record() -> F.Column:
    info = F.col("key_information")
    return F.to_json(F.struct("description", S.split_values(F.col("keywords")).alias("keywords"), "image_type", F.array(info, F.concat(info, F.lit(" ")), F.lit(" ")).alias("searchable_queries")))


def validate_analysis(spark: SparkSession, d: str) -> DataFrame:
    x = _chunk(spark, d).where("chunk_type = 'image'").select("obj_id", I.checked_analysis(_record()).alias("a"))
    return x.select("obj_id", "a.description", "a.image_type", "a.context_relation", F.size("a.keywords").alias("n_keywords"), F.size("a.key_information").alias("n_info"), F.array_join("a.searchable_queries", "|").alias("queries"))


def image_status(spark: SparkSession, d: str) -> DataFrame:
    response = F.when(F.col("description").isNotNull(), _record())
    return I.analysed(_chunk(spark, d).where("chunk_type = 'image'"), response).select("obj_id", "processing_status", F.col("analysis.description").alias("description"))


def enhance_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _chunk(spark, d).select("obj_id", E.eligible().alias("eligible"))


def chunk_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _chunk(spark, d).select("obj_id", E.prompt().alias("prompt"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Model responses of three kinds: pure JSON, JSON within text, and text that isn't JSON."""
    j = F.to_json(F.struct(F.coalesce("description", F.lit("-")).alias("description"), F.array("chunk_id").alias("keywords")))
    kind = F.col("obj_id") % 3
    text = F.when(kind == 0, j).when(kind == 1, F.concat(F.lit("说明：\n```json\n"), j, F.lit("\n```"))).otherwise(F.concat(F.lit("没有 "), "chunk_id"))
    return _chunk(spark, d).select("obj_id", text.alias("response"))


def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    x = _responses(spark, d).select("obj_id", E.salvaged(F.col("response")).alias("s"))
    return x.select("obj_id", "s.description", F.array_join("s.keywords", ",").alias("keywords"))


def json_block(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("obj_id", F.get_json_object(A.json_block(F.col("response")), "$.keywords[0]").alias("first_keyword"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunk(spark, d).select("obj_id", E.embedding_text().alias("embedding_text"))


def described_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Eligible rows described by the offline provider from their content."""
    got = E.call_model(_chunk(spark, d).where(E.eligible()), "obj_id", F.col("content"))
    return got.select("obj_id", E.salvaged(F.col("result")).alias("s")).select("obj_id", "s.description", F.array_join("s.keywords", ",").alias("keywords"))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of embedding texts by the offline provider; its dimension stands in for the vector in the result."""
    got = E.call_model(_chunk(spark, d), "obj_id", E.embedding_text(), method="embed")
    return got.select("obj_id", F.size("result").alias("dim"))


def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.ingest_metrics(_chunk(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        first_seen_images, image_anchor, image_attach, doc_title, image_window_context, validate_analysis, image_status, enhance_eligible, chunk_prompt,
        json_salvage, json_block, embedding_text, described_chunks, embedded_chunks, ingest_metrics,
    )
}
_SEEN = """seen AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_pos, r NULLS FIRST, c NULLS FIRST, ord, rel_id) - 1)::INT AS image_index FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, rel_id ORDER BY block_pos, r NULLS FIRST, c NULLS FIRST, ord) AS n FROM image_refs WHERE rel_id IS NOT NULL) WHERE n = 1)"""
_ANCHOR = f"""{_SEEN}, solid AS (SELECT doc_id, block_pos, sum(CASE WHEN kind = 'paragraph' AND {sql_shown("text")} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_pos) AS upto FROM (
    SELECT doc_id, block_pos, min(kind) AS kind, min(text) AS text FROM blocks GROUP BY doc_id, block_pos)),
  anch AS (SELECT i.doc_id, i.block_pos, rel_id, image_index, CASE WHEN r IS NOT NULL THEN 'table_cell' ELSE 'paragraph' END AS container_type,
    (CASE WHEN r IS NULL THEN greatest(coalesce(upto, 0), 1) END)::BIGINT AS paragraph_index, (r + 1)::INT AS row_no, c::INT AS col, replace(i.doc_id, '.', '_') || '_img_' || image_index AS filename
    FROM seen i LEFT JOIN solid s ON s.doc_id = i.doc_id AND s.block_pos = i.block_pos)"""
_TITLE = f"""ti AS (SELECT doc_id, coalesce(first(t ORDER BY seq, obj_id) FILTER (WHERE ok), '{I.NO_TITLE}') AS title FROM (SELECT doc_id, seq, obj_id, {sql_strip("content")} AS t,
    coalesce(chunk_type = 'text' AND length({sql_strip("content")}) BETWEEN 1 AND 99 AND right({sql_strip("content")}, 1) NOT IN ('.', '。', '！', '？'), false) AS ok FROM chunk) GROUP BY doc_id)"""
_T = "CASE WHEN chunk_type = 'text' THEN coalesce(content, '') END"
_ROLE = "CASE WHEN chunk_type = 'text' AND coalesce(is_fragment, false) THEN '{text_fragment}' WHEN chunk_type = 'table_full' THEN '{table_full}' WHEN chunk_type = 'table_row' THEN '{table_row}' WHEN chunk_type = 'image' THEN '{image}' ELSE '{text}' END".format(**E.ROLES)
_DESC, _WORDS = "CASE WHEN length(description) > 0 THEN description END", "CASE WHEN length(keywords) > 0 THEN keywords END"
_EMB = f"""CASE WHEN chunk_type = 'image' THEN coalesce(nullif(concat_ws(chr(10), '图片描述：' || {_DESC}, '关键词：' || {_WORDS}), ''), CASE WHEN length(original_filename) > 0 THEN '图片文件：' || original_filename ELSE '图片内容' END)
  WHEN chunk_type IN ('table_full', 'table_row') THEN coalesce(nullif(concat_ws(chr(10), {_DESC}, {_WORDS}), ''), coalesce(content, ''))
  ELSE concat_ws(chr(10), coalesce(content, ''), {_DESC}, {_WORDS}) END"""
_ELIGIBLE = "coalesce(chunk_type IN ('table_full', 'table_row') OR (chunk_type = 'text' AND coalesce(is_fragment, false)), false)"
_KEYS = f"CASE WHEN coalesce(keywords, '') = '' THEN [] ELSE list_transform(string_split(keywords, ','), lambda v: {sql_strip('v')}) END"
SQL = {
    "first_seen_images": f"WITH {_SEEN} SELECT doc_id, rel_id, block_pos, image_index FROM seen",
    "image_anchor": f"WITH {_ANCHOR} SELECT * FROM anch",
    "image_attach": f"WITH {_ANCHOR} SELECT doc_id, block_pos, string_agg(rel_id, ',' ORDER BY image_index) AS images FROM anch WHERE container_type = 'table_cell' GROUP BY doc_id, block_pos",
    "doc_title": f"WITH {_TITLE} SELECT doc_id, title FROM ti",
    "image_window_context": f"""WITH {_TITLE}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, obj_id) AS n FROM chunk),
      x AS (SELECT a.doc_id, a.obj_id, coalesce(string_agg(CASE WHEN b.n < a.n THEN b.t END, ' ' ORDER BY b.n), '') AS preceding, coalesce(string_agg(CASE WHEN b.n > a.n THEN b.t END, ' ' ORDER BY b.n), '') AS following, '第' || a.n || '个内容块' AS position
        FROM w a LEFT JOIN (SELECT doc_id, n, {_T} AS t FROM w) b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.n <> a.n WHERE a.chunk_type = 'image' GROUP BY a.doc_id, a.obj_id, a.n)
      SELECT x.*, title, concat_ws('，', '文档标题：' || title, '前文：' || nullif(preceding, ''), '后文：' || nullif(following, ''), '图片位置：' || position) AS context FROM x JOIN ti ON ti.doc_id = x.doc_id""",
    "validate_analysis": f"""SELECT obj_id, coalesce(description, '') AS description, coalesce(image_type, '') AS image_type, '' AS context_relation, len({_KEYS})::INT AS n_keywords, 0 AS n_info,
      coalesce(nullif({sql_strip("key_information")}, ''), '') AS queries FROM chunk WHERE chunk_type = 'image'""",
    "image_status": """SELECT obj_id, CASE WHEN description IS NOT NULL THEN 'completed' ELSE 'failed' END AS processing_status, coalesce(description, '图片分析失败，无法获取详细信息') AS description
      FROM chunk WHERE chunk_type = 'image'""",
    "enhance_eligible": f"SELECT obj_id, {_ELIGIBLE} AS eligible FROM chunk",
    "chunk_prompt": f"""SELECT obj_id, concat_ws(chr(10), {_ROLE}, CASE WHEN chunk_type = 'text' AND coalesce(is_fragment, false) THEN '分片 ' || fragment_index || '/' || total_fragments
      WHEN chunk_type IN ('table_full', 'table_row') THEN '表头：' || coalesce(header, '') WHEN chunk_type = 'text' THEN '段落 ' || coalesce(paragraph_index, 0) END,
      CASE WHEN length(context) > 0 THEN '上下文：' || context END, '内容：' || coalesce(content, ''), '{E.TASK}') AS prompt FROM chunk""",
    "json_salvage": "SELECT obj_id, CASE WHEN obj_id % 3 < 2 THEN coalesce(description, '-') ELSE '' END AS description, CASE WHEN obj_id % 3 < 2 THEN coalesce(chunk_id, '') ELSE '' END AS keywords FROM chunk",
    "json_block": "SELECT obj_id, CASE WHEN obj_id % 3 = 1 THEN chunk_id END AS first_keyword FROM chunk",
    "embedding_text": f"SELECT obj_id, {_EMB} AS embedding_text FROM chunk",
    "described_chunks": f"""SELECT obj_id, CASE WHEN {sql_shown("content")} THEN substr(content, 1, 20) ELSE '' END AS description, CASE WHEN {sql_shown("content")} THEN length(content)::VARCHAR ELSE '' END AS keywords
      FROM chunk WHERE {_ELIGIBLE}""",
    "embedded_chunks": f"SELECT obj_id, CASE WHEN {sql_shown(_EMB)} THEN 64 END AS dim FROM chunk",
    "ingest_metrics": f"""SELECT kb_id, doc_id, count(*) AS chunks, count_if(t) AS vectors, count_if(NOT t) AS failed, count_if(t AND kb_id IS NOT NULL) AS stored FROM (SELECT kb_id, doc_id, {sql_shown(_EMB)} AS t FROM chunk) GROUP BY kb_id, doc_id""",
}
