"""Files in, chunks and answers out: round trips through Word and Excel files, the store and streams, and the whole pipeline."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import enrich as E
from docloom.operators import grid as G
from docloom.operators.store import And, ContainsAny, Equal, Store, latest, predicate
from docloom.pipeline import CHUNK_PROPERTIES, GRAPH_PROPERTIES, Config, ImageConfig, TableConfig, ask, chunk_table, processed, semantic, word_chunks
from docloom.plans.retrieval import hybrid_sql
from docloom.plans.segment import _FRAGS, _PARAS, SIZE, chunker_sql
from docloom.runtime import scratch_path, table, written
from docloom.sources import ooxml as X
from docloom.streaming import ingest as I


def _grid(cells: list, pictures: dict) -> list:
    """Rows of a Word table from its cells in order; columns that a span covers are left out, gaps are blank cells."""
    rows: dict[int, list] = {}
    for x in cells:
        rows.setdefault(x["r"], []).append(x)
    out = []
    for r in range(max([*rows, *(k[0] for k in pictures), 0]) + 1):
        row, at = [], 0
        own = {x["c"]: x for x in rows.get(r, ())}
        for c in range(max([*own, *(k[1] for k in pictures if k[0] == r), -1]) + 1):
            if c < at and (c not in own or own[c]["text"] is None) and (r, c) not in pictures:
                continue
            x = own.get(c)
            wide = max(1, (x["grid_span"] or 1) if x else 1)
            row.append((x["text"] or "" if x else "", wide, x["v_merge"] if x else None, pictures.get((r, c), [])))
            at = c + wide
        out.append(row)
    return out if any(out) else [[("", 1, None)]]


def _docx_files(blocks: DataFrame, cells: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, content): a Word file of each document's blocks in order, with the cells of its tables and its pictures.

    A table without cells holds a blank one; pictures of a table without a place in it are in its first cell.
    """
    one = blocks.groupBy("doc_id", "block_pos").agg(F.min("kind").alias("kind"), F.coalesce(F.min("text"), F.lit("")).alias("text"), F.min("table_no").alias("table_no"))
    docs = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", "kind", "text", "table_no"))).alias("b"))
    grid = G.dedup(cells.where("sheet IS NULL")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "r", "c", "text", "grid_span", "v_merge"))).alias("cells"))
    refs = images.where("rel_id IS NOT NULL").distinct()
    refs = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", "r", "c", "ord", "rel_id"))).alias("refs"))
    docs = docs.join(grid, "doc_id", "left").join(refs, "doc_id", "left")

    def run(batches):
        for batch in batches:
            for doc in batch.to_pylist():
                tables: dict = {}
                for x in doc["cells"] or ():
                    tables.setdefault(x["table_id"], []).append(x)
                body = []
                for x in doc["b"]:
                    own = [i for i in doc["refs"] or () if i["block_pos"] == x["block_pos"]]
                    if x["kind"] == "paragraph":
                        body.append((x["text"], [i["rel_id"] for i in own]))
                        continue
                    pictures: dict = {}
                    for i in own:
                        pictures.setdefault((i["r"] or 0, i["c"] or 0), []).append(i["rel_id"])
                    body.append(_grid(tables.get(f"table_{x['table_no']}", []), pictures))
                yield pa.RecordBatch.from_arrays([pa.array([doc["doc_id"]]), pa.array([X.write_docx(body)])], names=["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id string, content binary")


def _word_files(spark: SparkSession, d: str) -> DataFrame:
    return _docx_files(table(spark, d, "blocks"), table(spark, d, "cells"), table(spark, d, "image_refs"))


def _xlsx_files(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(doc_id, content): a workbook of each document's sheets."""
    x = G.dedup(cells).where("sheet IS NOT NULL AND text IS NOT NULL")
    rows = x.select("doc_id", "sheet", F.col("r").alias("a"), F.col("c").alias("b"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("int").alias("e"), "text")
    m = G.distinct_merges(merges).select("doc_id", "sheet", F.col("min_row").alias("a"), F.col("max_row").alias("b"), F.col("min_col").alias("d"), F.col("max_col").alias("e"), F.lit(None).cast("string").alias("text"))
    docs = rows.unionByName(m).groupBy("doc_id").agg(F.collect_list(F.struct("sheet", "a", "b", "d", "e", "text")).alias("x"))

    def run(batches):
        for batch in batches:
            for doc, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sheets: dict = {}
                for i in items:
                    cells_, merges_ = sheets.setdefault(i["sheet"], ([], []))
                    if i["text"] is None:
                        merges_.append((i["a"], i["b"], i["d"], i["e"]))
                    else:
                        cells_.append((i["a"], i["b"], i["text"]))
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([X.write_xlsx(sheets)])], names=["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id string, content binary")


def docx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    got = X.read_word(_word_files(spark, d)).blocks()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_pos"))
    return got.select("doc_id", place.alias("n"), "kind", F.coalesce("text", F.lit("")).alias("text"))


def xlsx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    got = X.read_excel(_xlsx_files(table(spark, d, "cells"), table(spark, d, "merges"))).cells()
    return got.select("doc_id", "sheet", "r", "c", "text")


def xlsx_merges_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return X.read_excel(_xlsx_files(table(spark, d, "cells"), table(spark, d, "merges"))).merges()


def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "chunk").select("doc_id").distinct()
    return docs.select("doc_id", X.document_kind(F.col("doc_id")).alias("kind"))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows by base after: create, append all rows, replace the documents of 2024's rows, and replace them once more."""
    c = table(spark, d, "chunk").select("kb_id", "doc_id", "obj_id", "chunk_id", "stored_at")
    store = Store(spark, scratch_path(spark, "store"))
    store.create("chunks", {"doc_id": "text", "obj_id": "int", "chunk_id": "text"})
    store.drop("chunks")
    c.drop("stored_at").write.partitionBy("kb_id").parquet(f"{store.root}/chunks")
    batch = c.where("stored_at >= '2024-01-01'").drop("stored_at")
    store.replace_documents("chunks", batch)
    store.replace_documents("chunks", batch)
    return store.read("chunks").groupBy("kb_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("obj_id").alias("ids"))


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events stream, run over all of it."""
    path = scratch_path(spark, "stream")
    I.run_to_table(I.windowed_counts(I.read_files(spark, f"{d}/events.parquet")), f"{path}/out", f"{path}/state")
    got = spark.read.parquet(f"{path}/out")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


def document_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Word files and workbooks to stored chunks: parse, chunks of all kinds, fragments, descriptions, analyses, vectors and the store, counted per document."""
    word = X.read_word(files := written(_word_files(spark, d), "files")).once()
    excel = X.read_excel(_xlsx_files(table(spark, d, "cells"), table(spark, d, "merges"))).once()
    chunks = processed(word, excel, X.media(files), 1, Config(tables=TableConfig(rows=True)))
    store = Store(spark, scratch_path(spark, "store"))
    store.create("chunks", CHUNK_PROPERTIES)
    store.replace_documents("chunks", chunks.where("vector IS NOT NULL"))
    kinds = [F.count_if(F.col("chunk_type") == k).alias(n) for k, n in (("table_full", "tables"), ("table_row", "table_rows"), ("image", "images"))]
    return store.read("chunks").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("is_fragment").alias("fragments"), *kinds, F.sum(F.length(E.embedding_text())).alias("embedded_chars")
    )


def chunk_fragment_context(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt context of the fragments that the document flow makes of Word bodies."""
    bodies = table(spark, d, "blocks").where("kind = 'paragraph'")
    files = _docx_files(bodies, table(spark, d, "cells").limit(0), table(spark, d, "image_refs").limit(0))
    chunks = chunk_table(word_chunks(X.read_word(files).once()), 1)
    return chunks.where("is_fragment").select("doc_id", "paragraph_index", "fragment_index", "total_fragments", "content", "context")


def _attachment(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Of the document flow's chunks, those with pictures: their own, or named by a row or a table."""
    config = Config(tables=TableConfig(rows=True), images=ImageConfig(attach=mode))
    rows = word_chunks(X.read_word(written(_word_files(spark, d), "files")).once(), config)
    return rows.where("chunk_type = 'image' OR images IS NOT NULL").select("doc_id", "place", "chunk_type", "row_no", F.coalesce("rel_id", "images").alias("images"))


def attach_separate_block(spark: SparkSession, d: str) -> DataFrame:
    return _attachment(spark, d, "separate_block")


def attach_merge_into_row(spark: SparkSession, d: str) -> DataFrame:
    return _attachment(spark, d, "merge_into_row")


def attach_merge_into_table(spark: SparkSession, d: str) -> DataFrame:
    return _attachment(spark, d, "merge_into_table")


def word_cells_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The cells of Word tables, with spans and vertical merges, written into files and read from them again."""
    own = table(spark, d, "blocks").where("kind = 'table'").select("doc_id", F.concat(F.lit("table_"), "table_no").alias("table_id")).distinct()
    cells = X.read_word(_word_files(spark, d)).cells().join(own, ["doc_id", "table_id"], "left_semi")
    return cells.where("text <> ''").select("doc_id", "table_id", "r", "c", "text", "grid_span", "v_merge")


def _stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """A store of documents that have a vector, as chunks of three knowledge bases and four types."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    kinds = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("label") % len(_KINDS) + 1).cast("int"))
    rows = docs.join(vectors, "doc_id").select((F.col("doc_id") % 3).cast("int").alias("kb_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("obj_id"), kinds.alias("chunk_type"), "content", "vector")
    store = Store(spark, scratch_path(spark, "store"))
    store.create("chunks", {"doc_id": "text", "obj_id": "bigint", "chunk_type": "text", "content": "text", "vector": "vector"})
    store.replace_documents("chunks", rows)
    store.replace_documents("chunks", rows.where("obj_id % 5 = 0"))
    return store.read("chunks")


_KINDS = ("text", "table_full", "table_row", "image")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over the vectors of a store, in the question's knowledge base; documents with id % 100 = 0 ask by their text and vector."""
    chunks = _stored_documents(spark, d)
    return semantic(chunks.where("obj_id % 100 = 0").select(F.col("obj_id").alias("qid"), F.col("content").alias("text"), "vector", "kb_id"), chunks)


def semantic_typed_topk(spark: SparkSession, d: str) -> DataFrame:
    """As ``semantic_topk``, over texts and whole tables only."""
    chunks = _stored_documents(spark, d)
    asked = chunks.where("obj_id % 100 = 0").select(F.col("obj_id").alias("qid"), F.col("content").alias("text"), "vector", "kb_id")
    return semantic(asked, chunks, ["text", "table_full", "bogus"])


def store_bases(spark: SparkSession, d: str) -> DataFrame:
    """Objects by knowledge base after one of them was dropped and another one deleted from by a filter."""
    c = table(spark, d, "chunk").select("kb_id", "doc_id", F.col("obj_id").cast("long").alias("obj_id"), "chunk_id", "chunk_type")
    store = Store(spark, scratch_path(spark, "store"))
    store.create("chunks", {"doc_id": "text", "obj_id": "bigint", "chunk_id": "text", "chunk_type": "text"})
    store.insert("chunks", c)
    store.drop("chunks", 2)
    store.delete("chunks", And((Equal("kb_id", 1), ContainsAny("chunk_type", ("table_row", "image")))))
    return store.read("chunks").groupBy("kb_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("obj_id").alias("ids"))


def graph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A graph collection of questions and their hits: created, filled, thinned out by a filter and queried by another."""
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min("question").alias("question"), F.min("kb_id").alias("kb_id"))
    hits = table(spark, d, "hits").join(asked, "qid").select(
        "kb_id", F.col("qid").cast("string").alias("doc_id"), "chunk_id", "question", F.col("content").alias("answer"), F.col("chunk_type").alias("summary"),
        F.array("chunk_id").alias("sources"), F.lit(None).cast("array<float>").alias("vector"),
    )
    store = Store(spark, scratch_path(spark, "store"))
    store.create("graph", GRAPH_PROPERTIES)
    store.insert("graph", hits)
    store.delete("graph", Equal("summary", "image"))
    rows = store.read("graph").where(predicate(ContainsAny("summary", ("text", "table_full"))))
    return rows.groupBy("kb_id", "summary").agg(F.count(F.lit(1)).alias("objects"), F.sum(F.size("sources")).alias("sources"))


def ask_all(spark: SparkSession, d: str) -> DataFrame:
    """All questions against the latest row of every chunk: hybrid retrieval, context and the offline provider's answer."""
    chunks = table(spark, d, "chunk").select(*_ASKED, "obj_id", "stored_at")
    return ask(table(spark, d, "questions"), written(latest(chunks).select(*_ASKED), "latest"), hybrid=True)


#: What the flow reads of a chunk; the rest isn't moved.
_ASKED = ("kb_id", "chunk_id", "chunk_type", "content", "doc_id", "table_id", "row_no", "paragraph_index", "description", "keywords", "original_filename")


QUERIES = {
    f.__name__: f
    for f in (
        docx_roundtrip, word_cells_roundtrip, xlsx_roundtrip, xlsx_merges_roundtrip, format_dispatch, store_roundtrip, store_bases, graph_roundtrip, stream_window_counts, document_pipeline,
        chunk_fragment_context, attach_separate_block, attach_merge_into_row, attach_merge_into_table, semantic_topk, semantic_typed_topk, ask_all,
    )
}


def _semantic_sql(kinds: str = "") -> str:
    """The fusion over the documents with a vector, in the question's knowledge base."""
    kind = "CASE label % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
    rows = f"SELECT doc_id AS id, text, doc_id % 3 AS kb_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE true {kinds.format(kind=kind)}"
    asked = "SELECT doc_id AS qid, text, doc_id % 3 AS kb_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0"
    return hybrid_sql(rows, asked)


def _attach_sql(mode: str) -> str:
    """What the flow attaches: pictures as they are found in the written files, where a picture's cell is never null and each
    table is one block; the reader numbers blocks from 0, and pictures of a place in the order they were written."""
    cell = "b.kind = 'table'"
    key, kind, row = {"merge_into_row": ("f.doc_id, f.place, f.row_no", "'table_row'", "f.row_no"), "merge_into_table": ("f.doc_id, f.place", "'table_full'", "NULL::INT")}.get(mode, ("", "", ""))
    found = f"""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_pos) - 1)::INT AS place FROM (SELECT doc_id, block_pos, min(kind) AS kind, min(table_no) AS table_no FROM blocks GROUP BY doc_id, block_pos)),
      x AS (SELECT DISTINCT i.doc_id, b.place, CASE WHEN {cell} THEN coalesce(i.r, 0) END AS r, CASE WHEN {cell} THEN coalesce(i.c, 0) END AS c, i.ord, i.rel_id, {cell} AS in_table FROM image_refs i JOIN b USING (doc_id, block_pos) WHERE rel_id IS NOT NULL),
      u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rel_id ORDER BY place, r, c, ord) AS n FROM x) WHERE n = 1),
      f AS (SELECT doc_id, place, rel_id, in_table, (r + 1)::INT AS row_no, row_number() OVER (PARTITION BY doc_id ORDER BY place, r, c, ord, rel_id) AS image_index FROM u)"""
    own = "SELECT doc_id, place, 'image' AS chunk_type, row_no, rel_id AS images FROM f"
    if not key:
        return f"{found} {own}"
    return f"""{found} {own} WHERE NOT in_table UNION ALL SELECT doc_id, place, {kind} AS chunk_type, {row} AS row_no, string_agg(rel_id, ',' ORDER BY image_index) AS images FROM f WHERE in_table GROUP BY {key}"""


SQL = {
    "word_cells_roundtrip": """SELECT c.doc_id, c.table_id, r, c, min(text) AS text, coalesce(max(grid_span), 1)::INT AS grid_span, min(v_merge) AS v_merge FROM cells c
      JOIN (SELECT DISTINCT doc_id, 'table_' || table_no AS table_id FROM blocks WHERE kind = 'table') b ON b.doc_id = c.doc_id AND b.table_id = c.table_id
      WHERE sheet IS NULL GROUP BY c.doc_id, c.table_id, r, c HAVING coalesce(min(text), '') <> ''""",
    "store_bases": "SELECT kb_id, count(*) AS objects, sum(obj_id)::BIGINT AS ids FROM chunk WHERE kb_id IS DISTINCT FROM 2 AND NOT coalesce(kb_id = 1 AND chunk_type IN ('table_row', 'image'), false) GROUP BY kb_id",
    "graph_roundtrip": """SELECT kb_id, chunk_type AS summary, count(*) AS objects, count(*) AS sources FROM hits JOIN (SELECT qid, min(kb_id) AS kb_id FROM questions GROUP BY qid) USING (qid)
      WHERE chunk_type IN ('text', 'table_full') GROUP BY ALL""",
    "chunk_fragment_context": "WITH RECURSIVE " + chunker_sql(f"WITH {_PARAS} SELECT doc_id || chr(0) || paragraph_index AS id, content AS text FROM paras WHERE length(content) > {SIZE}") + f""", {_FRAGS}, {_PARAS}
      SELECT p.doc_id, p.paragraph_index, a.fragment_index, a.total_fragments, a.content, ' 段落分片 ' || a.fragment_index || '/' || a.total_fragments || ' ' ||
        coalesce('同段落其他分片: ' || string_agg('分片' || b.fragment_index || ': ' || substr(b.content, 1, 50) || '...', '; ' ORDER BY b.fragment_index), '') AS context
      FROM frags a JOIN paras p ON a.obj_id = p.doc_id || chr(0) || p.paragraph_index LEFT JOIN frags b ON b.obj_id = a.obj_id AND b.fragment_index <> a.fragment_index
      GROUP BY p.doc_id, p.paragraph_index, a.fragment_index, a.total_fragments, a.content""",
    "attach_separate_block": _attach_sql("separate_block"),
    "attach_merge_into_table": _attach_sql("merge_into_table"),
    "semantic_topk": _semantic_sql(),
    "semantic_typed_topk": _semantic_sql("AND {kind} IN ('text', 'table_full')"),
    "docx_roundtrip": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_pos)::INT AS n, kind, CASE WHEN kind = 'paragraph' THEN text ELSE '' END AS text FROM (
      SELECT doc_id, block_pos, min(kind) AS kind, coalesce(min(text), '') AS text FROM blocks GROUP BY doc_id, block_pos)""",
    "xlsx_roundtrip": "SELECT doc_id, sheet, r, c, min(text) AS text FROM cells WHERE sheet IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, sheet, r, c",
    "xlsx_merges_roundtrip": "SELECT DISTINCT doc_id, sheet, min_row, max_row, min_col, max_col FROM merges",
    "format_dispatch": "SELECT DISTINCT doc_id, CASE WHEN regexp_matches(lower(doc_id), '\\.(doc|docx)$') THEN 'word' WHEN regexp_matches(lower(doc_id), '\\.xlsx$') THEN 'excel' ELSE 'unsupported' END AS kind FROM chunk",
    "store_roundtrip": """WITH b AS (SELECT * FROM chunk WHERE stored_at >= '2024-01-01'), x AS (SELECT kb_id, obj_id FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kb_id = c.kb_id AND b.doc_id = c.doc_id)
      UNION ALL SELECT kb_id, obj_id FROM b) SELECT kb_id, count(*) AS objects, sum(obj_id)::BIGINT AS ids FROM x GROUP BY kb_id""",
    "stream_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
