"""Queries on the store, on retrieval and on answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import sql_shown, sql_strip
from docloom.operators import answer as A
from docloom.operators import retrieve as R
from docloom.operators import store as S
from docloom.runtime import table, written

K = 10


def _chunk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk")


def kb_view(spark: SparkSession, d: str) -> DataFrame:
    return S.kb_view(_chunk(spark, d))


def keyword_codec(spark: SparkSession, d: str) -> DataFrame:
    v = S.split_values(F.col("keywords"))
    return _chunk(spark, d).select("obj_id", F.size(v).alias("n_values"), S.join_values(v).alias("joined"))


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.collection_counts(_chunk(spark, d))


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(_chunk(spark, d).select("kb_id", "chunk_id", "obj_id", "stored_at")).drop("stored_at")


def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    """All rows, with the documents of the rows stored in 2024 or later replaced by those rows."""
    c = _chunk(spark, d).select("kb_id", "doc_id", "obj_id", "chunk_id", "stored_at")
    return S.upsert(c, c.where("stored_at >= '2024-01-01'")).drop("stored_at")


def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _chunk(spark, d).select("obj_id", "kb_id", "doc_id", "chunk_type")
    return S.delete_by_filter(c, S.And((S.Equal("kb_id", 1), S.ContainsAny("chunk_type", ("table_row", "image")))))


def filter_equal(spark: SparkSession, d: str) -> DataFrame:
    return S.filter_query(_chunk(spark, d).select("obj_id", "chunk_id", "kb_id"), S.Equal("kb_id", 2), limit=100)


def filter_contains_any(spark: SparkSession, d: str) -> DataFrame:
    f = S.ContainsAny("chunk_type", tuple(S.chunk_types(["table_full", "table_row", "bogus"])))
    return S.filter_query(_chunk(spark, d).select("obj_id", "chunk_id", "chunk_type"), f, limit=100)


def type_query_offset(spark: SparkSession, d: str) -> DataFrame:
    f = S.ContainsAny("chunk_type", tuple(S.chunk_types("text")))
    return S.filter_query(_chunk(spark, d).select("obj_id", "chunk_id", "content"), f, limit=100, offset=50)


def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return S.page(_chunk(spark, d).select("obj_id", "chunk_id"), after=100, limit=100)


def batch_validation(spark: SparkSession, d: str) -> DataFrame:
    return S.checked_batch(_chunk(spark, d)).groupBy("kb_id", "ok").agg(F.count(F.lit(1)).alias("rows"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("id % 100 = 0").withColumnRenamed("id", "qid")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_search(_vector_queries(spark, d), _vectors(spark, d), K)


def vector_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_search(_vector_queries(spark, d), _vectors(spark, d), K, most=0.7)


def vector_typed_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_search(_vector_queries(spark, d), _vectors(spark, d), K, same="label")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _chunk(spark, d).select(F.col("obj_id").alias("id"), F.col("content").alias("text"), "kb_id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return R.valid_questions(table(spark, d, "questions"), _chunk(spark, d))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its own k, then its own threshold; K stands in for a null k."""
    q = _asked(spark, d).where("outcome = 'ok'").select("qid", F.col("question").alias("text"), "kb_id", F.coalesce("k", F.lit(K)).alias("k"), "threshold")
    return R.above(R.bm25_search(q, _corpus(spark, d), "k", part=["kb_id"]), q).select("qid", "hit_rank", "id", "score")


def _hybrid(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    """Documents that have a vector ask by their whole text and vector; all scores of both sides are fused."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(docs.join(_vectors(spark, d).select("id", "vector"), "id", "full"), "both-sides")
    return R.hybrid_full(rows.where("id % 100 = 0 AND vector IS NOT NULL").withColumnRenamed("id", "qid"), rows.where("id IS NOT NULL"), K, least)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


def hybrid_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, 0.3)


def question_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("qid", "kb_id", "outcome")


def formatted_hits(spark: SparkSession, d: str) -> DataFrame:
    fields = ["kb_id", "chunk_id", "obj_id", "stored_at", "doc_id", "description", "keywords", "parent_id", "sheet", "table_id", "row_no", "header", "paragraph_index"]
    hits = table(spark, d, "hits")
    asked = _chunk(spark, d).select(*fields).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    x = R.formatted(hits, S.latest(asked).dropDuplicates(["chunk_id"]))
    return x.withColumn("metadata", F.get_json_object("metadata", "$.doc_id"))


def dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return A.dedup_hits(table(spark, d, "hits")).select("qid", "hit_rank", "chunk_id")


def merge_ranked(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_ranked(table(spark, d, "hits")).select("qid", "merged_rank", "hit_rank", "chunk_id", "score")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return A.within_budget(A.merge_ranked(table(spark, d, "hits")), budget=600).select("qid", "merged_rank", "chunk_id", "running")


def source_tags(spark: SparkSession, d: str) -> DataFrame:
    return A.tagged(A.merge_ranked(table(spark, d, "hits")), _chunk(spark, d)).select("qid", "merged_rank", "source")


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    return A.contexts(A.tagged(A.within_budget(A.merge_ranked(table(spark, d, "hits"))), _chunk(spark, d)))


def response_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.response_sources(A.merge_ranked(table(spark, d, "hits")))


def answer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Answers by an offline stand-in for the model: the length of its prompt."""
    return A.answers(_asked(spark, d), answer_context(spark, d), lambda p: F.concat(F.lit("prompt of "), F.length(p), F.lit(" characters")))


QUERIES = {
    f.__name__: f
    for f in (
        kb_view, keyword_codec, collection_counts, latest_chunks, upsert_replace, delete_by_filter, filter_equal, filter_contains_any, type_query_offset,
        cursor_page, batch_validation, vector_topk, vector_topk_threshold, vector_typed_topk, bm25_topk, hybrid_topk, hybrid_topk_threshold,
        question_outcome, formatted_hits, dedup_prefix, merge_ranked, context_budget, source_tags, answer_context, response_sources, answer_outcomes,
    )
}

_PROPS = ", ".join(f"coalesce({k}, {v!r}) AS {k}" for k, v in S.PROPERTIES.items())


def _vec_sql(same: str = "", most: str = "", k: int = K) -> str:
    return f"""SELECT qid, hit_rank, id, round(1 - score, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS hit_rank FROM (
      SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON true {same} WHERE q.vec_id % 100 = 0))
      WHERE hit_rank <= {k} {most}"""


def _terms(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return rf"""list_concat(regexp_extract_all({low}, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all({low}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda b: list_transform(range(1, length(b)), lambda i: substr(b, i::BIGINT, 2)))))"""


def _bm25(corpus: str, queries: str, part: bool, k: int) -> str:
    on, col = ("AND a.kb_id = s.kb_id", ", kb_id") if part else ("", "")
    return f"""corpus AS ({corpus}), qs AS ({queries}), s AS (SELECT id{col}, {_terms("text")} AS t FROM corpus), tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM s),
      post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM s) GROUP BY id, term),
      df AS (SELECT term, count(*) AS df FROM post GROUP BY term), a AS (SELECT DISTINCT qid{col}, unnest({_terms("text")}) AS term FROM qs),
      bm AS (SELECT a.qid, s.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * len(s.t) / mean))), 6) AS score
        FROM a JOIN post USING (term) JOIN df USING (term) JOIN s ON s.id = post.id {on} CROSS JOIN tot GROUP BY a.qid, s.id),
      bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS hit_rank FROM bm) WHERE hit_rank <= {k})"""


_ASKED = f"""asked AS (SELECT q.*, CASE WHEN NOT {sql_shown("question")} THEN 'invalid question' WHEN NOT EXISTS (SELECT 1 FROM chunk c WHERE c.kb_id = q.kb_id) THEN 'nothing found' ELSE 'ok' END AS outcome
  FROM (SELECT qid, min(question) AS question, min(kb_id) AS kb_id FROM questions GROUP BY qid) q)"""


def hybrid_sql(rows: str, asked: str, least: str = "", vectors: str = "") -> str:
    """The fusion over all scores of both sides: ``rows`` (id, text, and kb_id, embedding), ``asked`` (qid, text, and kb_id, embedding);
    within a knowledge base, unless ``vectors`` gives the vector scores (qid, id, score) by themselves."""
    ve = vectors or "SELECT q.qid, c.id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM qs q JOIN corpus c ON c.kb_id = q.kb_id"
    return f"""WITH {_bm25(rows, asked, not vectors, K)},
  ve AS ({ve}),
  sc AS (SELECT qid, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS x, side FROM (SELECT *, min(score) OVER (PARTITION BY qid, side) AS lo, max(score) OVER (PARTITION BY qid, side) AS hi FROM (
    SELECT qid, id, score, 'v' AS side FROM ve UNION ALL SELECT qid, id, score, 't' FROM bm))),
  fu AS (SELECT qid, id, round({R.ALPHA} * coalesce(max(CASE WHEN side = 'v' THEN x END), 0.0) + {1 - R.ALPHA} * coalesce(max(CASE WHEN side = 't' THEN x END), 0.0), 6) AS score FROM sc GROUP BY qid, id)
  SELECT qid, hit_rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS hit_rank FROM fu) WHERE hit_rank <= {K} {least}"""


def _documents_sql(least: str = "") -> str:
    return hybrid_sql(
        "SELECT doc_id AS id, text FROM documents", "SELECT vec_id AS qid, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0", least,
        "SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON true WHERE q.vec_id % 100 = 0",
    )


_DEDUP = """dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, substr(coalesce(content, ''), 1, 100) ORDER BY hit_rank, chunk_id) AS n FROM hits) WHERE n = 1),
  mr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, hit_rank, chunk_id)::INT AS merged_rank FROM dd),
  ru AS (SELECT *, sum(length(coalesce(content, ''))) OVER (PARTITION BY qid ORDER BY merged_rank)::BIGINT AS running FROM mr)"""
_TAGS = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY obj_id) AS n FROM chunk) WHERE n = 1),
  tg AS (SELECT h.qid, h.merged_rank, h.running, concat_ws(chr(10), '[来源: ' || coalesce(o.doc_id, '未知文件') || CASE WHEN h.chunk_type = 'table_full' THEN ', 表格: ' || coalesce(o.table_id, '未知表格')
      WHEN h.chunk_type = 'table_row' THEN ', 表格行: ' || coalesce(o.row_no::VARCHAR, '未知行') ELSE ', 段落: ' || coalesce(o.paragraph_index::VARCHAR, '未知段落') END || ']',
      CASE WHEN length(o.description) > 0 THEN '描述: ' || o.description END, CASE WHEN length(o.keywords) > 0 THEN '关键词: ' || o.keywords END, coalesce(h.content, '')) AS source
    FROM ru h LEFT JOIN one o ON o.chunk_id = h.chunk_id),
  cx AS (SELECT qid, count(*) AS sources, string_agg(source, chr(10) || chr(10) ORDER BY merged_rank) AS context FROM tg WHERE running <= 32768 GROUP BY qid)"""
_VALUES = f"CASE WHEN coalesce(keywords, '') = '' THEN [] ELSE list_transform(string_split(keywords, ','), lambda v: {sql_strip('v')}) END"
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, chunk_id ORDER BY stored_at DESC NULLS LAST, obj_id DESC) AS n FROM chunk) WHERE n = 1)"
SQL = {
    "kb_view": f"SELECT obj_id, kb_id, {_PROPS}, CASE WHEN chunk_type = 'image' THEN coalesce(content, '') ELSE '' END AS image_path FROM chunk",
    "keyword_codec": f"SELECT obj_id, len(v)::INT AS n_values, coalesce(array_to_string(v, ', '), '') AS joined FROM (SELECT obj_id, {_VALUES} AS v FROM chunk)",
    "collection_counts": "SELECT kb_id, count(*) AS objects, count(DISTINCT doc_id) AS documents, count(DISTINCT chunk_id) AS chunks FROM chunk GROUP BY kb_id",
    "latest_chunks": f"SELECT kb_id, chunk_id, obj_id FROM {_LATEST}",
    "upsert_replace": """WITH b AS (SELECT kb_id, doc_id, obj_id, chunk_id FROM chunk WHERE stored_at >= '2024-01-01')
      SELECT kb_id, doc_id, obj_id, chunk_id FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kb_id = c.kb_id AND b.doc_id = c.doc_id) UNION ALL SELECT * FROM b""",
    "delete_by_filter": "SELECT obj_id, kb_id, doc_id, chunk_type FROM chunk WHERE NOT coalesce(kb_id = 1 AND chunk_type IN ('table_row', 'image'), false)",
    "filter_equal": "SELECT obj_id, chunk_id, kb_id FROM chunk WHERE kb_id = 2 ORDER BY chunk_id, obj_id LIMIT 100",
    "filter_contains_any": "SELECT obj_id, chunk_id, chunk_type FROM chunk WHERE chunk_type IN ('table_full', 'table_row') ORDER BY chunk_id, obj_id LIMIT 100",
    "type_query_offset": "SELECT obj_id, chunk_id, content FROM chunk WHERE chunk_type = 'text' ORDER BY chunk_id, obj_id LIMIT 100 OFFSET 50",
    "cursor_page": "WITH p AS (SELECT obj_id, chunk_id FROM chunk WHERE obj_id > 100 ORDER BY obj_id LIMIT 100) SELECT *, (SELECT CASE WHEN count(*) = 100 THEN max(obj_id) END FROM p) AS next_cursor FROM p",
    "batch_validation": """SELECT kb_id, kb_id IS NOT NULL AND doc_id IS NOT NULL AND chunk_id IS NOT NULL AND coalesce(chunk_type IN ('text', 'table_full', 'table_row', 'image'), false) AS ok,
      count(*) AS rows FROM chunk GROUP BY ALL""",
    "vector_topk": _vec_sql(),
    "vector_topk_threshold": _vec_sql(most="AND round(1 - score, 6) <= 0.7"),
    "vector_typed_topk": _vec_sql(same="AND c.label = q.label"),
    "bm25_topk": f"""WITH {_ASKED}, own AS (SELECT qid, coalesce(min(k), {K}) AS k, min(threshold) AS threshold FROM questions GROUP BY qid),
      {_bm25('SELECT obj_id AS id, content AS text, kb_id FROM chunk', 'SELECT qid, question AS text, kb_id FROM asked WHERE outcome = ' + chr(39) + 'ok' + chr(39), True, 1_000_000)}
      SELECT qid, hit_rank, id, score FROM bmk JOIN own USING (qid) WHERE hit_rank <= own.k AND (own.threshold IS NULL OR score >= own.threshold)""",
    "hybrid_topk": _documents_sql(),
    "hybrid_topk_threshold": _documents_sql("AND score >= 0.3"),
    "question_outcome": f"WITH {_ASKED} SELECT qid, kb_id, outcome FROM asked",
    "formatted_hits": f"""SELECT h.qid, h.hit_rank, h.chunk_id, h.chunk_type, h.content, coalesce(h.score, 0.0) AS similarity_score, c.doc_id AS metadata FROM hits h
      LEFT JOIN (SELECT chunk_id, min(doc_id) AS doc_id FROM {_LATEST} GROUP BY chunk_id) c ON c.chunk_id = h.chunk_id""",
    "dedup_prefix": f"WITH {_DEDUP} SELECT qid, hit_rank, chunk_id FROM dd",
    "merge_ranked": f"WITH {_DEDUP} SELECT qid, merged_rank, hit_rank, chunk_id, score FROM mr",
    "context_budget": f"WITH {_DEDUP} SELECT qid, merged_rank, chunk_id, running FROM ru WHERE running <= 600",
    "source_tags": f"WITH {_DEDUP}, {_TAGS} SELECT qid, merged_rank, source FROM tg",
    "answer_context": f"WITH {_DEDUP}, {_TAGS} SELECT qid, sources, context FROM cx",
    "response_sources": f"""WITH {_DEDUP} SELECT * FROM (SELECT qid, merged_rank, coalesce(chunk_type, 'text') AS chunk_type, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE coalesce(content, '') END AS content,
      coalesce(score, 0.0) AS similarity_score, count(*) OVER (PARTITION BY qid) AS total_sources FROM mr) WHERE merged_rank <= 8""",
    "answer_outcomes": f"""WITH {_DEDUP}, {_TAGS}, {_ASKED} SELECT a.qid, outcome = 'ok' AND cx.context IS NOT NULL AS success,
      CASE WHEN outcome = 'ok' AND cx.context IS NOT NULL THEN 'prompt of ' || length('请仅根据以下资料回答问题。' || chr(10) || chr(10) || '资料：' || chr(10) || cx.context || chr(10) || chr(10) || '问题：' || a.question) || ' characters' END AS answer,
      CASE WHEN outcome = 'invalid question' THEN outcome WHEN outcome <> 'ok' OR cx.context IS NULL THEN 'nothing found' END AS error, coalesce(sources, 0) AS total_sources
      FROM asked a LEFT JOIN cx ON cx.qid = a.qid""",
}
