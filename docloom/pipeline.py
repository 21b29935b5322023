"""Files to chunks to the store, and questions to answers: the whole flow as DataFrames.

A folder of Word and Excel files becomes one chunk table (text, table_full, table_row, image), long texts in fragments whose
context is rebuilt, numbered per document; rows are described, pictures analysed and all of it embedded by a provider, and
they replace the documents' earlier rows in the store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import enrich as E
from docloom.operators import grid as G
from docloom.operators import images as I
from docloom.operators import segment as S
from docloom.operators.answer import answer_prompt, contexts, merge_ranked, tagged, within_budget
from docloom.operators.retrieve import ALPHA, above, bm25_search, hybrid_full, valid_questions
from docloom.operators.store import ContainsAny, Store, chunk_types, predicate
from docloom.runtime import numbered, spread, written
from docloom.sources import ooxml as X

#: Up to so many hits are broadcast to the chunks; beyond, chunks and hits are joined by shuffle.
BROADCAST_HITS = 200_000
# Properties of the two kinds of collection.
CHUNK_PROPERTIES = {
    "doc_id": "text", "seq": "int", "chunk_id": "text", "chunk_type": "text", "content": "text", "context": "text", "parent_id": "text", "paragraph_index": "int",
    "is_fragment": "bool", "fragment_index": "int", "total_fragments": "int", "sheet": "text", "table_id": "text", "row_no": "int", "header_rows": "int",
    "header": "text", "table_format": "text", "original_filename": "text", "image_index": "int", "rel_id": "text", "images": "text", "description": "text",
    "keywords": "text", "image_type": "text", "context_relation": "text", "key_information": "text", "searchable_queries": "text", "processing_status": "text", "vector": "vector",
}
GRAPH_PROPERTIES = {"doc_id": "text", "chunk_id": "text", "question": "text", "answer": "text", "summary": "text", "sources": "text_array", "vector": "vector"}
#: Properties that later steps than ``chunk_table`` fill.
_LATER = ("description", "keywords", "image_type", "context_relation", "key_information", "searchable_queries", "processing_status", "vector")


@dataclass(frozen=True)
class TableConfig:
    """How tables become chunks: ``markdown`` or ``html``; whole tables only, or their rows too."""

    format: str = "markdown"
    rows: bool = False

    def __post_init__(self) -> None:
        if self.format not in ("markdown", "html"):
            raise ValueError(f"unknown table format {self.format!r}")


@dataclass(frozen=True)
class ImageConfig:
    """Pictures of tables as chunks of their own, or named by their row's or their table's chunk; rows of text around a picture
    that its analysis is given."""

    attach: str = "separate_block"
    window: int = 2

    def __post_init__(self) -> None:
        if self.attach not in I.ATTACHMENTS:
            raise ValueError(f"unknown attachment {self.attach!r}")
        if self.window < 1:
            raise ValueError("window must be at least 1")


@dataclass(frozen=True)
class Config:
    fragments: S.FragmentConfig = field(default_factory=S.FragmentConfig)
    tables: TableConfig = field(default_factory=TableConfig)
    images: ImageConfig = field(default_factory=ImageConfig)


_COLUMNS = ["doc_id", "place", "part", "chunk_type", "content", "context", "parent_id", "paragraph_index", "sheet", "table_id", "row_no", "header_rows", "header", "table_format", "original_filename", "image_index", "rel_id", "images"]
_TYPES = {"place": "int", "part": "int", "paragraph_index": "int", "row_no": "int", "header_rows": "int", "image_index": "int"}


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in _COLUMNS])


def word_chunks(parsed: X.Parsed, config: Config = Config()) -> DataFrame:
    """Chunks of Word files in body order: paragraphs, tables (and rows), then the images of a place."""
    blocks, cells = written(parsed.blocks(), "blocks"), G.dedup(parsed.cells().where("sheet IS NULL"))
    paras = S.body_paragraphs(blocks)
    near = S.table_neighbours(blocks)
    if config.fragments.enabled:  # long neighbours are named by their fragments
        near = near.drop("context").join(S.table_fragment_context(near, paras, config.fragments), ["doc_id", "block_pos"])
    order = paras.select("doc_id", "block_pos", "paragraph_index", "content")
    prev = order.select("doc_id", (F.col("paragraph_index") + 1).alias("paragraph_index"), F.col("content").alias("p"))
    nxt = order.select("doc_id", (F.col("paragraph_index") - 1).alias("paragraph_index"), F.col("content").alias("n"))
    around = order.join(prev, ["doc_id", "paragraph_index"], "left").join(nxt, ["doc_id", "paragraph_index"], "left")
    empty = F.lit("")
    context = F.concat(F.lit(S.BEFORE), F.coalesce("p", empty), F.lit(S.AFTER), F.coalesce("n", empty))
    texts = around.select("doc_id", F.col("block_pos").alias("place"), F.lit(0).alias("part"), F.lit("text").alias("chunk_type"), "content", context.alias("context"), "paragraph_index")

    votes = G.header_votes(cells)
    heads = written(G.word_headers(cells, votes), "word-headers")
    body = G.word_tables(cells, votes, heads).join(heads.select("doc_id", "table_id", "header"), ["doc_id", "table_id"]).join(votes.select("doc_id", "table_id", "header_rows"), ["doc_id", "table_id"])
    at = near.select("doc_id", F.concat(F.lit("table_"), F.col("table_no")).alias("table_id"), F.col("block_pos").alias("place"), "context")
    body = at.join(body, ["doc_id", "table_id"])
    header = F.array_join("header", ", ")
    images = I.anchored(I.first_seen(parsed.images()), blocks)
    by_row, by_table = config.tables.rows and config.images.attach == "merge_into_row", config.images.attach == "merge_into_table"
    named = I.attached(images, config.images.attach).withColumnRenamed("block_pos", "place") if by_row or by_table else None
    tables = body.select(
        "doc_id", "place", F.lit(0).alias("part"), F.lit("table_full").alias("chunk_type"), F.col(config.tables.format).alias("content"), "context", "table_id",
        "header_rows", header.alias("header"), F.lit(config.tables.format).alias("table_format"),
    )
    parts = [texts, tables.join(named, ["doc_id", "place"], "left") if by_table else tables]
    if config.tables.rows:
        g = G.resolved(cells).groupBy("doc_id", "table_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda s: s["text"]).alias("vals"))
        rows = g.join(body.select("doc_id", "table_id", "place", "context", "header_rows", header.alias("header")), ["doc_id", "table_id"]).where(F.col("r") >= F.col("header_rows"))
        text = G.markdown_row("vals") if config.tables.format == "markdown" else G.html_row("vals")
        rows = rows.select(
            "doc_id", "place", (F.col("r") + 1).alias("part"), F.lit("table_row").alias("chunk_type"), text.alias("content"), "context", F.col("table_id").alias("parent_id"), "table_id",
            (F.col("r") + 1).cast("int").alias("row_no"), "header", F.lit(config.tables.format).alias("table_format"),
        )
        parts.append(rows.join(named, ["doc_id", "place", "row_no"], "left") if by_row else rows)
    if by_row or by_table:  # pictures of a row or table that has no chunk stay chunks of their own
        holders = (rows.select("doc_id", "place", "row_no") if by_row else tables.select("doc_id", "place")).withColumnRenamed("place", "block_pos")
        cell = F.col("container_type") == "table_cell"
        images = images.where(~cell).unionByName(images.where(cell).join(holders, holders.columns, "left_anti").select(*images.columns))
    parts.append(images.select(
        "doc_id", F.col("block_pos").alias("place"), (F.lit(1_000_000) + F.col("image_index")).alias("part"), F.lit("image").alias("chunk_type"), F.col("filename").alias("content"),
        F.col("filename").alias("original_filename"), "image_index", "paragraph_index", "row_no", "rel_id",
    ))
    return reduce(DataFrame.unionByName, map(_shaped, parts))


def excel_chunks(parsed: X.Parsed, config: Config = Config()) -> DataFrame:
    """Chunks of workbooks: a block of a sheet is a table; with rows, each body row too."""
    cells, merges = written(parsed.cells().where("sheet IS NOT NULL"), "cells"), written(parsed.merges(), "merges")
    cells = G.dedup(cells)
    frame = written(G.frames(G.table_blocks(G.merge_cover(G.table_rows(cells), merges))), "frames")
    merged = G.header_merges(frame, cells, merges)
    heads = G.headers(frame, merged)
    full = G.full_tables(frame, heads, merges)
    if config.tables.format == "html":
        full = G.same_table(full.drop("content"), G.html_tables(frame, merged).withColumnRenamed("html", "content"), G.BLOCK)
    order = F.dense_rank().over(G.Window.partitionBy("doc_id").orderBy("sheet", "block_no"))
    full = full.withColumn("place", order)
    kind = F.lit(config.tables.format).alias("table_format")
    out = _shaped(full.select("doc_id", "place", F.lit(0).alias("part"), F.lit("table_full").alias("chunk_type"), "content", "context", "sheet", F.col("chunk_table_id").alias("table_id"), "header_rows", "header", kind))
    if config.tables.rows:
        rows = G.same_table(G.row_chunks(frame), full.select(*G.BLOCK, "place", "chunk_table_id", "header"), G.BLOCK)
        text = F.col("content") if config.tables.format == "markdown" else F.col("html")
        out = out.unionByName(_shaped(rows.select(
            "doc_id", "place", F.col("row_no").alias("part"), F.lit("table_row").alias("chunk_type"), text.alias("content"), "context", F.col("chunk_table_id").alias("parent_id"), "sheet",
            F.col("chunk_table_id").alias("table_id"), "row_no", "header", kind,
        )))
    return out


def chunk_table(rows: DataFrame, kb_id: int, config: Config = Config()) -> DataFrame:
    """The stored form: long texts as fragments with rebuilt context, seq from 0 and chunk_id per document, in body order."""
    rows = numbered(rows, ["doc_id"], "place", ["part"], "n")
    ids = written(rows.withColumn("obj_id", F.xxhash64("doc_id", "n")).withColumn("is_fragment", F.lit(False)), "chunks")
    if config.fragments.enabled:
        cut = written(S.fragments(ids, config.fragments).select("obj_id", "fragment_index", "total_fragments", "content"), "fragments")
        about = S.sibling_context(cut).withColumnRenamed("context", "rebuilt")
        x = ids.join(cut.withColumnRenamed("content", "piece").join(about, ["obj_id", "fragment_index"]), "obj_id", "left")
    else:
        x = ids.withColumns({c: F.lit(None).cast(t) for c, t in (("fragment_index", "int"), ("total_fragments", "int"), ("piece", "string"), ("rebuilt", "string"))})
    x = x.withColumn("is_fragment", F.col("piece").isNotNull()).withColumn("content", F.coalesce("piece", "content")).withColumn("context", F.coalesce("rebuilt", "context"))
    x = numbered(x, ["doc_id"], "n", ["fragment_index"], "seq1")
    x = x.withColumn("seq", F.col("seq1") - 1).withColumn("chunk_id", F.concat_ws("_", "doc_id", "seq1")).withColumn("kb_id", F.lit(kb_id))
    return x.select("kb_id", *[c for c in CHUNK_PROPERTIES if c not in _LATER])


def described(chunks: DataFrame, make: Callable[[], E.Provider] = E.Offline) -> DataFrame:
    """Chunks with description and keywords of eligible rows, empty on failure; the order of rows is kept in ``seq``."""
    got = E.appended(spread(chunks), "said", F.when(E.eligible(), E.prompt()), make).withColumn("s", E.salvaged(F.col("said")))
    none = F.lit("")
    return got.select(*chunks.columns, F.coalesce("s.description", none).alias("description"), F.coalesce(F.array_join("s.keywords", ", "), none).alias("keywords"))


def pictured(chunks: DataFrame, pictures: DataFrame, make: Callable[[], E.Provider] = E.Offline, window: int = 2) -> DataFrame:
    """Chunks with the analysis of their pictures (doc_id, rel_id, content): what the provider says of a picture in its context,
    or the record of a failure; ``processing_status`` is completed or failed. Other rows get no analysis."""
    keyed = chunks.withColumn("obj_id", F.xxhash64("doc_id", "seq"))
    context = I.image_context(keyed, window).select("obj_id", F.col("context").alias("about"))
    seen = pictures.groupBy("doc_id", "rel_id").agg(F.min("content").alias("picture"))
    asked = keyed.where("chunk_type = 'image'").join(context, "obj_id", "left").join(seen, ["doc_id", "rel_id"], "left")
    got = E.call_model(asked, "obj_id", I.analysis_prompt(F.coalesce("about", F.lit(""))), make, "vision", F.col("picture"))
    done = I.analysed(got, F.col("result")).select(
        "obj_id", "processing_status", F.col("analysis.description").alias("said"), F.array_join("analysis.keywords", ", ").alias("words"), F.col("analysis.image_type").alias("image_type"),
        F.col("analysis.context_relation").alias("context_relation"), F.array_join("analysis.key_information", ", ").alias("key_information"),
        F.array_join("analysis.searchable_queries", "\n").alias("searchable_queries"),
    )
    x = keyed.join(done, "obj_id", "left").withColumn("description", F.coalesce("said", "description")).withColumn("keywords", F.coalesce("words", "keywords"))
    return x.select(*chunks.columns, "image_type", "context_relation", "key_information", "searchable_queries", "processing_status")


def embedded(chunks: DataFrame, make: Callable[[], E.Provider] = E.Offline) -> DataFrame:
    """Chunks with the vector of their embedding text, null on failure."""
    queries = F.split("searchable_queries", "\n") if "searchable_queries" in chunks.columns else None
    return E.appended(spread(chunks), "vector", E.embedding_text(queries), make, "embed")


def processed(word: X.Parsed, excel: X.Parsed, pictures: DataFrame, kb_id: int, config: Config = Config(), make: Callable[[], E.Provider] = E.Offline) -> DataFrame:
    """Parsed files as chunks of all kinds: fragmented, described, pictures analysed, embedded."""
    rows = word_chunks(word, config).unionByName(excel_chunks(excel, config))
    chunks = written(described(chunk_table(rows, kb_id, config), make), "described")
    chunks = written(pictured(chunks, pictures, make, config.images.window), "pictured")
    return written(embedded(chunks, make), "ingest")


def ingest(
    spark: SparkSession, folder: str, store: Store, kb_id: int, name: str = "chunks", config: Config = Config(), make: Callable[[], E.Provider] = E.Offline, recreate: bool = False,
    convert: Callable[[bytes], bytes] | None = None,
) -> DataFrame:
    """Take a folder's files into a knowledge base; documents that are there already are replaced, or with ``recreate`` all of this
    base, others never. Only chunks with a vector are stored; a document of which none has one keeps its earlier rows.
    ``convert`` is for older Word files. Returns counts per document and a row with ``error`` per file that couldn't be read."""
    store.create(name, CHUNK_PROPERTIES)
    files = X.files(spark, folder)
    kind = X.document_kind(F.col("path"))
    word, excel = X.read_word(files.where(kind == "word"), convert).once(), X.read_excel(files.where(kind == "excel")).once()
    chunks = processed(word, excel, X.media(files.where(kind == "word")), kb_id, config, make)
    if recreate:
        store.drop(name, kb_id)
    store.replace_documents(name, chunks.where("vector IS NOT NULL"))
    bad = word.errors().unionByName(excel.errors()).unionByName(files.where(kind == "unsupported").select("doc_id", F.lit("unsupported file type").alias("error")))
    counts = E.ingest_metrics(chunks).withColumn("error", F.lit(None).cast("string"))
    return counts.unionByName(bad.select("doc_id", "error").withColumn("kb_id", F.lit(kb_id)), allowMissingColumns=True)


def semantic(questions: DataFrame, chunks: DataFrame, types: str | list[str] | None = None, key: str = "obj_id", k: int | str = 10, alpha: float = ALPHA) -> DataFrame:
    """(qid, hit_rank, id, score): the best chunks of each question (qid, text, vector, kb_id) in its knowledge base, by the
    fusion of keyword and vector scores over the chunks (<key>, content, vector, kb_id, chunk_type); with ``types``, over
    chunks of these types only. A filter on the types is a column, so it reaches the scan. No known type gives no hit."""
    if types is not None:
        chunks = chunks.where(predicate(ContainsAny("chunk_type", tuple(chunk_types(types)))))
    return hybrid_full(questions, chunks.select(F.col(key).alias("id"), F.coalesce("content", F.lit("")).alias("text"), "vector", "kb_id"), k, alpha=alpha, same="kb_id")


def ask(questions: DataFrame, chunks: DataFrame, make: Callable[[], E.Provider] = E.Offline, hits: int = 8, hybrid: bool = False) -> DataFrame:
    """(qid, success, answer, error, total_sources): retrieval, context and a provider's answer for a batch of questions.

    Each question has its own number of hits and least score; ``hits`` stands in for a null k, and a null threshold drops none.
    Retrieval is by keywords, or, with ``hybrid``, by the fusion of keyword and vector scores within the knowledge base;
    chunks without a column ``vector`` are embedded first. A text that several questions of a base ask is embedded and searched for once.
    """
    checked = written(valid_questions(questions, chunks), "questions")
    corpus = chunks.withColumn("obj_id", F.xxhash64("kb_id", "chunk_id"))
    if hybrid and "vector" not in chunks.columns:
        corpus = embedded(corpus, make)
    used = ["kb_id", "obj_id", "chunk_id", "chunk_type", "content", "doc_id", "table_id", "row_no", "paragraph_index", "description", "keywords", *(["vector"] if hybrid else [])]
    corpus = written(corpus.select(*used), "corpus")
    q = checked.where("outcome = 'ok'").select("qid", F.col("question").alias("text"), "kb_id", F.coalesce("k", F.lit(hits)).alias("k"), "threshold")
    if hybrid:
        once = q.groupBy("kb_id", "text").agg(F.min("qid").alias("first_qid"), F.max("k").alias("most"))
        asked = E.appended(once, "vector", F.col("text"), make, "embed").select(F.col("first_qid").alias("qid"), "text", "kb_id", "most", "vector")
        found = semantic(asked, corpus, k="most").withColumnRenamed("qid", "first_qid")
        same = q.join(once, ["kb_id", "text"]).select("first_qid", "qid", "k")
        found = found.join(same, "first_qid").where(F.col("hit_rank") <= F.col("k")).select("qid", "hit_rank", "id", "score")
    else:
        texts = corpus.select(F.col("obj_id").alias("id"), F.col("content").alias("text"), "kb_id")
        found = bm25_search(q, texts, "k", part=["kb_id"])
    found = written(above(found, q), "found")
    few = found.count() <= BROADCAST_HITS
    got = corpus.select(F.col("obj_id").alias("id"), "chunk_id", "chunk_type", "content").join(F.broadcast(found) if few else found, "id")
    got = written(got.select("qid", "hit_rank", "chunk_id", "chunk_type", "content", "score"), "got")
    names = got.select("chunk_id").distinct()
    about = corpus.drop("vector").join(F.broadcast(names) if few else names, "chunk_id", "left_semi")
    ctx = contexts(tagged(within_budget(merge_ranked(got)), about))
    ready = written(checked.join(ctx, "qid", "left").withColumn("prompt", F.when(F.col("context").isNotNull(), answer_prompt(F.col("question"), F.col("context")))), "prompts")
    x = E.appended(ready, "said", F.col("prompt"), make)
    error = (
        F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("context").isNull(), "nothing found").when(F.coalesce(F.length("said"), F.lit(0)) == 0, "generation failed")
    )
    return x.select("qid", error.isNull().alias("success"), F.when(error.isNull(), F.col("said")).alias("answer"), error.alias("error"), F.coalesce("sources", F.lit(0)).alias("total_sources"))
