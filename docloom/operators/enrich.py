"""Enrichment: prompts, model providers behind Arrow iterators, salvage of model JSON, and the text that is embedded."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import or_empty, strip

# The wording of an image's embedding text.
LABELS = {"description": "图片描述：", "keywords": "关键词：", "queries": "搜索意图：", "file": "图片文件：", "nothing": "图片内容"}
ROLES = {
    "text": "你负责概括文本段落。", "text_fragment": "你负责概括段落的一个分片。", "table_full": "你负责概括整张表格。", "table_row": "你负责结合表头概括表格的一行。", "image": "你负责结合上下文概括图片。",
}
#: Rows of one call to a provider.
CALL_ROWS = 64
TASK = "请只输出 JSON：{\"description\": \"…\", \"keywords\": [\"…\"]}"


class Provider(Protocol):
    """A model service. Calls may be repeated after a lost executor, so they must be idempotent."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...

    def vision(self, prompts: list[str], images: list[bytes]) -> list[str | None]: ...


class Offline:
    """A deterministic stand-in: describes a prompt by its first characters, embeds by hashing."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def complete(self, prompts: list[str]) -> list[str | None]:
        return ["结果 " + json.dumps({"description": p[:20], "keywords": [str(len(p))]}, ensure_ascii=False) for p in prompts]

    def vision(self, prompts: list[str], images: list[bytes]) -> list[str | None]:
        """As the model of a vision service would be asked: the picture as a data URI, an analysis record back."""
        uris = [data_uri(b) for b in images]
        return [json.dumps({"description": f"图片 {len(b)} 字节", "keywords": [u[5 : u.index(";")]], "image_type": "unknown", "context_relation": p[:20], "key_information": [], "searchable_queries": [p[:10]]}, ensure_ascii=False) for p, b, u in zip(prompts, images, uris)]

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Counts of pairs of neighbouring characters, hashed to places and signs, as a unit vector."""
        out: list[list[float] | None] = []
        for t in texts:
            if not t.strip():
                out.append(None)
                continue
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            codes = codes if len(codes) > 1 else np.append(codes, np.uint64(0))
            h = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            v = np.bincount(((h >> np.uint64(20)) % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dim)
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


def data_uri(image: bytes) -> str:
    """A picture as a data URI of its kind, as vision services take it."""
    kind = "png" if image[:4] == b"\x89PNG" else "gif" if image[:3] == b"GIF" else "jpeg"
    return f"data:image/{kind};base64,{base64.b64encode(image).decode()}"


def with_retry(call: Callable, tries: int = 3, first: float = 4.0, most: float = 10.0, kinds: tuple = (ConnectionError, TimeoutError), sleep: Callable = time.sleep):
    """``call()``, again after an exponential pause on the given errors; the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except kinds:
            if n == tries - 1:
                raise
            sleep(min(most, first * 2**n))


def _asked(call: Callable, rows: list) -> list:
    """``call`` of many rows; if it fails for good, of each by itself, so that only the failing ones come out null."""
    try:
        return list(with_retry(lambda: call(rows)))
    except Exception:  # of any kind: a row's failure must not end the others, nor the job
        out = []
        for r in rows:
            try:
                out += call([r])
            except Exception:
                out.append(None)
        return out


def _batches(make: Callable[[], Provider], method: str, kind: pa.DataType, keep: int, name: str):
    """Batches of ``keep`` columns, the text and perhaps a picture to those columns and what the provider says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        call = (lambda rows: provider.vision(*map(list, zip(*rows)))) if method == "vision" else getattr(provider, method)
        for b in batches:
            texts = b.column(keep).to_pylist()
            images = b.column(keep + 1).to_pylist() if method == "vision" else None
            asked = [i for i, t in enumerate(texts) if t is not None and t.strip() and (images is None or images[i])]
            got: list = [None] * len(texts)
            for at in range(0, len(asked), CALL_ROWS):
                some = asked[at : at + CALL_ROWS]
                for i, a in zip(some, _asked(call, [texts[i] if images is None else (texts[i], images[i]) for i in some])):
                    got[i] = a
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(got, kind)], names=[*b.schema.names[:keep], name])

    return run


def appended(df: DataFrame, name: str, text: Column, make: Callable[[], Provider] = Offline, method: str = "complete", image: Column | None = None) -> DataFrame:
    """``df`` with a column of the provider's answer (complete, vision) or vector (embed), made in one pass where the rows are;
    null for blank texts, missing pictures and failed calls. Rows are asked CALL_ROWS at a time; where that fails, one by one."""
    kind, result = (pa.list_(pa.float32()), T.ArrayType(T.FloatType())) if method == "embed" else (pa.string(), T.StringType())
    rows = df.select(*df.columns, text.alias("__docloom_text"), *([image.alias("__docloom_image")] if method == "vision" else []))
    schema = T.StructType([*df.schema.fields, T.StructField(name, result)])
    return rows.mapInArrow(_batches(make, method, kind, len(df.columns), name), schema)


def call_model(df: DataFrame, key: str, text: Column, make: Callable[[], Provider] = Offline, method: str = "complete", image: Column | None = None) -> DataFrame:
    """(<key>, result) of each row; see ``appended``."""
    rows = df.select(key, text.alias("__docloom_asked"), *([image.alias("__docloom_shown")] if method == "vision" else []))
    return appended(rows, "result", F.col("__docloom_asked"), make, method, F.col("__docloom_shown") if method == "vision" else None).select(key, "result")


def eligible() -> Column:
    """Tables, rows of tables and fragments of text are described; other rows aren't."""
    return F.coalesce(F.col("chunk_type").isin("table_full", "table_row") | ((F.col("chunk_type") == "text") & F.coalesce(F.col("is_fragment"), F.lit(False))), F.lit(False))


def prompt() -> Column:
    """The model prompt of a chunk by its type, with its context if it has one."""
    frag = (F.col("chunk_type") == "text") & F.coalesce(F.col("is_fragment"), F.lit(False))
    kind = F.when(frag, "text_fragment").otherwise(F.col("chunk_type"))
    role = F.coalesce(*[F.when(kind == k, v) for k, v in ROLES.items()], F.lit(ROLES["text"]))
    where = (
        F.when(kind == "text_fragment", F.concat(F.lit("分片 "), F.col("fragment_index"), F.lit("/"), F.col("total_fragments")))
        .when(F.col("chunk_type").isin("table_full", "table_row"), F.concat(F.lit("表头："), or_empty(F.col("header"))))
        .when(F.col("chunk_type") == "text", F.concat(F.lit("段落 "), F.coalesce(F.col("paragraph_index"), F.lit(0))))
    )
    context = F.when(F.length("context") > 0, F.concat(F.lit("上下文："), F.col("context")))
    return F.concat_ws("\n", role, where, context, F.concat(F.lit("内容："), or_empty(F.col("content"))), F.lit(TASK))


def salvaged(response: Column) -> Column:
    """description and keywords of a model's JSON: the whole text, else its widest part in braces, else empty values."""
    schema = "description string, keywords array<string>"
    inner = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    parsed = F.when(F.get_json_object(response, "$").startswith("{"), F.from_json(response, schema)).when(F.get_json_object(inner, "$").isNotNull(), F.from_json(inner, schema))
    return F.struct(or_empty(parsed["description"]).alias("description"), F.coalesce(parsed["keywords"], F.array().cast("array<string>")).alias("keywords"))


def embedding_text(queries: Column | None = None) -> Column:
    """What is embedded of a chunk. Images: labelled description, keywords and up to five distinct queries, else the file
    name, else a fixed word. Tables: description and keywords, else the content. Texts: content, description, keywords."""
    desc, words = F.when(F.length("description") > 0, F.col("description")), F.when(F.length("keywords") > 0, F.col("keywords"))
    asked = queries if queries is not None else F.array().cast("array<string>")
    clean = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(asked, F.array().cast("array<string>")), strip), lambda q: q != "")), 1, 5)
    image = F.concat_ws(
        "\n", F.concat(F.lit(LABELS["description"]), desc), F.concat(F.lit(LABELS["keywords"]), words), F.when(F.size(clean) > 0, F.concat(F.lit(LABELS["queries"]), F.array_join(clean, "; ")))
    )
    name = F.when(F.length("original_filename") > 0, F.concat(F.lit(LABELS["file"]), F.col("original_filename"))).otherwise(LABELS["nothing"])
    table = F.concat_ws("\n", desc, words)
    return (
        F.when(F.col("chunk_type") == "image", F.when(image != "", image).otherwise(name))
        .when(F.col("chunk_type").isin("table_full", "table_row"), F.when(table != "", table).otherwise(or_empty(F.col("content"))))
        .otherwise(F.concat_ws("\n", or_empty(F.col("content")), desc, words))
    )


def ingest_metrics(chunks: DataFrame) -> DataFrame:
    """(kb_id, doc_id, chunks, vectors, failed, stored) per document: a row is stored if it has a vector and a base. Without
    a column ``vector``, rows with a text to embed count as having one."""
    text = F.col("vector").isNotNull() if "vector" in chunks.columns else F.length(strip(embedding_text())) > 0
    return chunks.groupBy("kb_id", "doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(text).alias("vectors"), F.count_if(~text).alias("failed"), F.count_if(text & F.col("kb_id").isNotNull()).alias("stored")
    )
