"""Images of documents: first occurrences, anchors, attachment to tables, surrounding text, and checked analysis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import or_empty, shown, strip
from docloom.runtime import numbered, running

# The wording of image context, and the record of a failed analysis.
NO_TITLE = "未知文档"
CONTEXT_LABELS = (("title", "文档标题："), ("preceding", "前文："), ("following", "后文："), ("position", "图片位置："))
PLACE = "第", "个内容块"
FALLBACK = {"description": "图片分析失败，无法获取详细信息", "keywords": ("图片", "分析失败"), "image_type": "unknown", "context_relation": "无法确定与文档的关系"}
TASK = "请结合上下文分析图片，只输出 JSON：{\"description\": \"…\", \"keywords\": [\"…\"], \"image_type\": \"…\", \"context_relation\": \"…\", \"key_information\": [\"…\"], \"searchable_queries\": [\"…\"]}"
ATTACHMENTS = ("separate_block", "merge_into_row", "merge_into_table")
ANALYSIS = T.StructType(
    [
        T.StructField("description", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("image_type", T.StringType()),
        T.StructField("context_relation", T.StringType()), T.StructField("key_information", T.ArrayType(T.StringType())),
        T.StructField("searchable_queries", T.ArrayType(T.StringType())),
    ]
)


def first_seen(refs: DataFrame) -> DataFrame:
    """Image references with image_index: of each relation of a document the first place, numbered from 0; null relations and repeats fall out."""
    place = F.struct(*[F.col(c) for c in ("block_pos", "r", "c", "ord")], F.struct(*[F.col(c) for c in refs.columns]).alias("row"))
    firsts = refs.where("rel_id IS NOT NULL").groupBy(F.col("doc_id").alias("__docloom_d"), F.col("rel_id").alias("__docloom_r")).agg(F.min(place).alias("__docloom_p"))
    return numbered(firsts.select("__docloom_p.row.*"), ["doc_id"], "block_pos", ["r", "c", "ord", "rel_id"], "n").withColumn("image_index", F.col("n") - 1).drop("n")


def anchored(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Images with container_type, paragraph_index, row_no, col and filename. An image in a blank paragraph is anchored to
    the paragraph before, or to 1; one in a table to its cell."""
    one = blocks.groupBy("doc_id", "block_pos").agg(F.min("kind").alias("kind"), F.min("text").alias("text"))
    solid = ((F.col("kind") == "paragraph") & shown(F.col("text"))).cast("int")
    upto = running(one, ["doc_id"], "block_pos", [], solid, "upto").select("doc_id", "block_pos", F.col("upto").cast("long").alias("upto"))
    x = images.join(upto, ["doc_id", "block_pos"], "left")
    cell = F.col("r").isNotNull()
    return x.select(
        "doc_id", "block_pos", "rel_id", "image_index", F.when(cell, "table_cell").otherwise("paragraph").alias("container_type"),
        F.when(~cell, F.greatest(F.coalesce("upto", F.lit(0)), F.lit(1))).alias("paragraph_index"), (F.col("r") + 1).cast("int").alias("row_no"), F.col("c").cast("int").alias("col"),
        F.concat(F.regexp_replace("doc_id", r"\.", "_"), F.lit("_img_"), F.col("image_index")).alias("filename"),
    )


def attached(images: DataFrame, mode: str) -> DataFrame:
    """Images of tables by attachment. separate_block: as they are; merge_into_row, merge_into_table: (doc_id, block_pos[, row_no], images),
    the relations in order joined by commas."""
    own = images.where("container_type = 'table_cell'")
    if mode == "separate_block":
        return own
    keys = {"merge_into_row": ["doc_id", "block_pos", "row_no"], "merge_into_table": ["doc_id", "block_pos"]}[mode]
    parts = F.array_sort(F.collect_list(F.struct("image_index", "rel_id")))
    return own.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["rel_id"]), ",").alias("images"))


def doc_titles(chunks: DataFrame) -> DataFrame:
    """(doc_id, title): the first text of under 100 characters that doesn't end like a sentence, else a fixed name."""
    t = strip(F.col("content"))
    fits = (F.col("chunk_type") == "text") & (F.length(t) > 0) & (F.length(t) < 100) & ~F.substring(t, -1, 1).isin(".", "。", "！", "？")
    return chunks.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(fits, t), F.when(fits, F.struct("seq", "obj_id"))), F.lit(NO_TITLE)).alias("title"))


def image_context(chunks: DataFrame, window: int = 2) -> DataFrame:
    """(doc_id, obj_id, preceding, following, title, position, context) of image rows: texts within ``window`` rows, the
    document's title, the row's place, and all of it in one line. The rows around an image are found by their number."""
    rows = numbered(chunks.select("doc_id", "seq", "obj_id", "chunk_type", "content"), ["doc_id"], "seq", ["obj_id"], "n")
    images = rows.where("chunk_type = 'image'").select("doc_id", "obj_id", "n")
    texts = rows.where("chunk_type = 'text'").select("doc_id", F.col("n").alias("at"), or_empty(F.col("content")).alias("t"))
    steps = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    near = images.withColumn("step", steps).withColumn("at", F.col("n") + F.col("step")).join(texts, ["doc_id", "at"], "left")

    def side(cond) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & F.col("t").isNotNull(), F.struct("step", "t")))), lambda s: s["t"]), " ")

    x = near.groupBy("doc_id", "obj_id", "n").agg(side(F.col("step") < 0).alias("preceding"), side(F.col("step") > 0).alias("following"))
    x = x.join(doc_titles(chunks), "doc_id").withColumn("position", F.concat(F.lit(PLACE[0]), F.col("n"), F.lit(PLACE[1])))
    parts = [F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c))) for c, label in CONTEXT_LABELS]
    return x.select("doc_id", "obj_id", "preceding", "following", "title", "position", F.concat_ws("，", *parts).alias("context"))


def analysis_prompt(context: Column) -> Column:
    """What a vision model is asked about a picture: its context, if there is any, and the form of the answer."""
    return F.concat_ws("\n", F.when(F.length(context) > 0, context), F.lit(TASK))


def checked_analysis(record: Column) -> Column:
    """A record from a model's JSON: missing or wrongly typed lists are empty, texts "", queries stripped, distinct and non-blank."""
    x = F.from_json(record, ANALYSIS)
    none = F.array().cast("array<string>")
    queries = F.array_distinct(F.filter(F.transform(F.coalesce(x["searchable_queries"], none), strip), lambda q: q != ""))
    return F.struct(
        or_empty(x["description"]).alias("description"), F.coalesce(x["keywords"], none).alias("keywords"), or_empty(x["image_type"]).alias("image_type"),
        or_empty(x["context_relation"]).alias("context_relation"), F.coalesce(x["key_information"], none).alias("key_information"), queries.alias("searchable_queries"),
    )


def fallback_analysis() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(FALLBACK["description"]).alias("description"), F.array(*map(F.lit, FALLBACK["keywords"])).alias("keywords"), F.lit(FALLBACK["image_type"]).alias("image_type"),
        F.lit(FALLBACK["context_relation"]).alias("context_relation"), none.alias("key_information"), none.alias("searchable_queries"),
    )


def analysed(images: DataFrame, response: Column) -> DataFrame:
    """Images with analysis and processing_status: completed where the response is a JSON object, else failed with the fallback."""
    good = F.coalesce(F.get_json_object(response, "$").startswith("{"), F.lit(False))
    return images.withColumn("processing_status", F.when(good, "completed").otherwise("failed")).withColumn("analysis", F.when(good, checked_analysis(response)).otherwise(fallback_analysis()))
