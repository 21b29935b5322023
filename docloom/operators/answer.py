"""Answer assembly for batches of questions: hits without repeats, in order, within a length budget, as a tagged context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import or_empty, shown

# The wording of source tags.
TAGS = {"source": "[来源: ", "table": ", 表格: ", "row": ", 表格行: ", "paragraph": ", 段落: ", "description": "描述", "keywords": "关键词"}
UNKNOWN = {"source": "未知文件", "table": "未知表格", "row": "未知行", "paragraph": "未知段落"}
PREFIX, BUDGET, SOURCES, SHOWN = 100, 32_768, 8, 500


def dedup_hits(hits: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Of the hits of a question that share the first ``prefix`` characters, the first in retrieval order; null reads as empty."""
    w = Window.partitionBy("qid", F.substring(or_empty(F.col("content")), 1, prefix)).orderBy("hit_rank", "chunk_id")
    return hits.withColumn("__docloom_n", F.row_number().over(w)).where("__docloom_n = 1").drop("__docloom_n")


def merge_ranked(hits: DataFrame) -> DataFrame:
    """Hits without repeats, with merged_rank: by score, then retrieval order; a null score counts 0."""
    w = Window.partitionBy("qid").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "hit_rank", "chunk_id")
    return dedup_hits(hits).withColumn("merged_rank", F.row_number().over(w))


def within_budget(merged: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The hits before the first with which the contents' running length passes the budget; a first hit over it leaves none."""
    w = Window.partitionBy("qid").orderBy("merged_rank").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("running", F.sum(F.length(or_empty(F.col("content")))).over(w)).where(F.col("running") <= budget)


def source_tag() -> Column:
    """Where a hit comes from, its description and keywords if any, and its content, a line each."""

    def known(c: str, else_: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(else_))

    place = (
        F.when(F.col("chunk_type") == "table_full", F.concat(F.lit(TAGS["table"]), known("table_id", UNKNOWN["table"])))
        .when(F.col("chunk_type") == "table_row", F.concat(F.lit(TAGS["row"]), known("row_no", UNKNOWN["row"])))
        .otherwise(F.concat(F.lit(TAGS["paragraph"]), known("paragraph_index", UNKNOWN["paragraph"])))
    )
    head = F.concat(F.lit(TAGS["source"]), known("doc_id", UNKNOWN["source"]), place, F.lit("]"))
    about = [F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c)) for label, c in ((TAGS["description"], F.col("description")), (TAGS["keywords"], F.col("keywords")))]
    return F.concat_ws("\n", head, *about, or_empty(F.col("content")))


def tagged(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with source: the tagged text, from the chunk's row (the one of the least obj_id of a chunk id)."""
    fields = ["doc_id", "table_id", "row_no", "paragraph_index", "description", "keywords"]
    asked = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    one = asked.groupBy("chunk_id").agg(F.min_by(F.struct(*fields), "obj_id").alias("m")).select("chunk_id", *[f"m.{f}" for f in fields])
    return hits.join(one, "chunk_id", "left").withColumn("source", source_tag())


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, sources, context): the tagged texts of a question in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("merged_rank", "source")))
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.transform(parts, lambda s: s["source"]), "\n\n").alias("context"))


def response_sources(merged: DataFrame) -> DataFrame:
    """(qid, merged_rank, chunk_type, content, similarity_score, total_sources): up to SOURCES per question, long contents cut."""
    c = or_empty(F.col("content"))
    cut = F.when(F.length(c) > SHOWN, F.concat(F.substring(c, 1, SHOWN), F.lit("..."))).otherwise(c)
    total = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    x = merged.withColumn("total_sources", total).where(F.col("merged_rank") <= SOURCES)
    return x.select("qid", "merged_rank", F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"), cut.alias("content"), F.coalesce("score", F.lit(0.0)).alias("similarity_score"), "total_sources")


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("请仅根据以下资料回答问题。\n\n资料：\n"), context, F.lit("\n\n问题："), question)


def answers(questions: DataFrame, context: DataFrame, complete) -> DataFrame:
    """(qid, success, answer, error, total_sources) of checked questions; ``complete``: column of prompts to column of answers.

    The four outcomes: an invalid question, nothing found, a failed generation (a null or blank answer), an answer.
    """
    x = questions.join(context, "qid", "left").withColumn("prompt", answer_prompt(F.col("question"), or_empty(F.col("context"))))
    asked = x.withColumn("answer", F.when((F.col("outcome") == "ok") & F.col("context").isNotNull(), complete(F.col("prompt"))))
    error = (
        F.when(F.col("outcome") == "invalid question", "invalid question").when((F.col("outcome") != "ok") | F.col("context").isNull(), "nothing found")
        .when(~shown(F.col("answer")), "generation failed")
    )
    return asked.select("qid", error.isNull().alias("success"), F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("error"), F.coalesce("sources", F.lit(0)).alias("total_sources"))


def json_block(answer: Column) -> Column:
    """The first fenced JSON object of an answer, as text, or null."""
    found = F.regexp_extract(answer, r"(?is)```json\s*(\{.*?\})\s*```", 1)
    return F.when(found != "", found)


def image_previews(answer_rows: DataFrame, files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Answers (qid, answer, image_path) with preview: a data URI of the named file (path, content) unless it is too large or missing."""
    small = files.where(F.length("content") <= most_bytes).select(F.col("path").alias("image_path"), "content")
    ext = F.lower(F.regexp_extract("image_path", r"\.(\w+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "gif", "image/gif").otherwise("image/png")
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content"))
    return answer_rows.join(small, "image_path", "left").withColumn("preview", F.when(F.col("content").isNotNull(), uri)).drop("content")
