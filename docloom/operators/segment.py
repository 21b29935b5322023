"""Text segmentation: paragraphs, their context, the punctuation-aware chunker, fragments and rebuilt context."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import or_empty, shown
from docloom.runtime import numbered, running, spread

# Cut marks by rank, and the reach of the search around the wanted end.
CUT_MARKS = ("\n。！？)）!?", ";；…:：", ",，\t .")
REACH = 100
# The wording of context.
BEFORE, AFTER = "上一段：", "。下一段："
PIECE, PIECE_OF, OTHERS = "分片", " 段落分片 ", "同段落其他分片: "


@dataclass(frozen=True)
class FragmentConfig:
    """Sizes of the chunker, checked on construction."""

    enabled: bool = True
    size: int = 500
    overlap: int = 50
    least: int = 100

    def __post_init__(self) -> None:
        for wrong, why in (
            (self.size <= 0, "size must be positive"),
            (self.overlap < 0, "overlap must not be negative"),
            (self.overlap >= self.size, "overlap must be less than size"),
            (self.least <= 0, "least must be positive"),
            (self.least >= self.size, "least must be less than size"),
        ):
            if wrong:
                raise ValueError(why)


_FRAGMENT = "fragment_index int, total_fragments int, start_pos int, end_pos int, fragment_start_pos int, fragment_end_pos int, content string"
#: What ``text.strip`` takes off.
_BLANKS = " \t\n\x0b\x0c\r" + "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp"))
_MARKS = [re.compile(f"[{re.escape(m)}]") for m in CUT_MARKS]
_SPACE = re.compile(r"\s")


def _last_mark(text: str, lo: int, hi: int) -> int:
    """Behind the last mark of the best rank present in [lo, hi), or -1."""
    window = text[lo:hi]
    for marks in CUT_MARKS:
        at = max(map(window.rfind, marks))
        if at >= 0:
            return lo + at + 1
    return -1


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each chunk. A cut lies behind the best mark within REACH of the wanted end; failing one, or where
    it falls exactly there, behind the next blank; the next chunk starts behind the best mark in the overlap."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    out, start = [], 0
    while True:
        want = cut = min(start + size, n)
        if want < n:
            lo, hi = max(want - REACH, start), min(want + REACH, n)
            if (best := _last_mark(text, lo, hi)) >= 0:
                cut = best
            if cut == want:
                blank = _SPACE.search(text, want, hi)
                cut = blank.end() if blank else n if hi == n else want
        if text[start:cut].strip():
            out.append((start, cut))
        if cut >= n:
            return out
        best = _last_mark(text, max(cut - overlap, start), cut)
        again = best if best >= 0 else cut - overlap
        start = cut if again <= start else again


def _span_batches(size: int, overlap: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, no, lo, hi, part = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (s, e) in enumerate(spans(t or "", size, overlap), 1):
                    src.append(i), no.append(k), lo.append(s), hi.append(e), part.append(t[s:e])
            cols = [b.column(0).take(pa.array(src, pa.int64())), pa.array(no, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(part, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "chunk_no", "start_pos", "end_pos", "content"])

    return run


def chunk_split(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(<key>, chunk_no, start_pos, end_pos, content) of every text; null and empty texts give no row."""
    FragmentConfig(size=size, overlap=overlap, least=1)
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text")))
    out = rows.mapInArrow(_span_batches(size, overlap, None), f"id {kind}, chunk_no int, start_pos int, end_pos int, content string")
    return out.withColumnRenamed("id", key)


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(<key>, paragraph_index, content, context): the non-blank lines of each text, numbered from 1, with the lines around.

    Lines of one text stay in its row until they are exploded, so nothing is shuffled. Texts without a line give no row.
    """
    lines = F.filter(F.split(F.col(text), "\n"), shown)
    # the outer form keeps the optimizer from adding a filter that would cut the text into lines again
    rows = df.select(F.col(key), lines.alias("lines")).select(key, "lines", F.posexplode_outer("lines").alias("i", "content")).where("content IS NOT NULL")
    near = [or_empty(F.get("lines", F.col("i") + step)) for step in (-1, 1)]
    context = F.concat(F.lit(BEFORE), F.when(F.col("i") > 0, near[0]).otherwise(""), F.lit(AFTER), near[1])
    return rows.select(key, (F.col("i") + 1).alias("paragraph_index"), "content", context.alias("context"))


def body_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_pos, paragraph_index, content) of the non-blank paragraphs of Word bodies; repeated rows count once."""
    rows = blocks.where("kind = 'paragraph'").where(shown(F.col("text"))).select("doc_id", "block_pos", F.col("text").alias("content"))
    rows = rows.groupBy("doc_id", "block_pos").agg(F.min("content").alias("content"))
    return numbered(rows, ["doc_id"], "block_pos", [], "paragraph_index")


def lookup_paragraph(paras: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (doc_id, paragraph_index) with the content found there, null outside the document's bounds."""
    return asked.join(paras.select("doc_id", "paragraph_index", "content"), ["doc_id", "paragraph_index"], "left")


def should_fragment(config: FragmentConfig) -> Column:
    """Text rows over the size that aren't fragments already."""
    return (
        F.lit(config.enabled) & (F.col("chunk_type") == "text") & (F.length("content") > config.size) & ~F.coalesce(F.col("is_fragment"), F.lit(False))
    )


def _fragment_batches(config: FragmentConfig):
    """(id, text) to the numbered fragments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            src, cols = [], [[] for _ in kinds]
            for i, t in enumerate(b.column(1).to_pylist()):
                cut = [(s, e, t[s:e]) for s, e in spans(t, config.size, config.overlap)]
                cut = [x for x in cut if len(x[2].strip(_BLANKS)) >= config.least]
                for k, (s, e, piece) in enumerate(cut, 1):
                    first = t.find(piece)
                    src.append(i)
                    for c, v in zip(cols, (k, len(cut), s, e, first, first + len(piece), piece)):
                        c.append(v)
            cols = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(src, pa.int64())), *cols], names=["id", *[c.split()[0] for c in _FRAGMENT.split(", ")]])

    return run


def fragments(chunks: DataFrame, config: FragmentConfig = FragmentConfig()) -> DataFrame:
    """(obj_id, fragment_index, total_fragments, start_pos, end_pos, fragment_start_pos, fragment_end_pos, content).

    Of the chunker's pieces those of fewer than ``least`` characters without outer blanks are dropped, the rest numbered.
    A row of which no piece is left gives no fragment: the original stands for it. start_pos is the piece's true place,
    fragment_start_pos the place where its text first occurs. All of it is done where the text is; an obj_id that occurs
    twice counts once.
    """
    long = chunks.where(should_fragment(config)).select("obj_id", F.col("content").alias("original")).dropDuplicates(["obj_id"])
    out = long.mapInArrow(_fragment_batches(config), f"id {dict(chunks.dtypes)['obj_id']}, {_FRAGMENT}")
    return out.withColumnRenamed("id", "obj_id")


def with_fragments(chunks: DataFrame, config: FragmentConfig = FragmentConfig()) -> DataFrame:
    """(doc_id, seq, obj_id, paragraph_index, chunk_type, is_fragment, fragment_index, total_fragments, content, position,
    chunk_id): the chunk list with long texts replaced by their fragments, in order and numbered anew."""
    cut = fragments(chunks, config).select("obj_id", "fragment_index", "total_fragments", F.col("content").alias("piece"))
    base = chunks.select("doc_id", "seq", "obj_id", "paragraph_index", "chunk_type", "content", F.coalesce("is_fragment", F.lit(False)).alias("was"))
    x = base.join(cut, "obj_id", "left")
    x = x.select(
        "doc_id", "seq", "obj_id", "paragraph_index", "chunk_type", (F.col("was") | F.col("piece").isNotNull()).alias("is_fragment"),
        "fragment_index", "total_fragments", F.coalesce("piece", "content").alias("content"),
    )
    x = numbered(x, ["doc_id"], "seq", ["obj_id", "fragment_index"], "position")
    return x.withColumn("chunk_id", F.concat_ws("_", "doc_id", "position"))


def position_map(expanded: DataFrame) -> DataFrame:
    """(doc_id, seq, obj_id, first_position, positions): where each original row went, the positions joined by commas."""
    spots = F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda p: p.cast("string")), ",")
    return expanded.groupBy("doc_id", "seq", "obj_id").agg(F.min("position").alias("first_position"), spots.alias("positions"))


def sibling_context(cut: DataFrame) -> DataFrame:
    """(obj_id, fragment_index, context): the rebuilt context of each fragment, naming the other fragments of its text.

    The original paragraph is gone by then, so its own context is empty and the text starts with a blank.
    """
    own = Window.partitionBy("obj_id")
    about = F.struct("fragment_index", F.concat(F.lit(PIECE), F.col("fragment_index"), F.lit(": "), F.substring("content", 1, 50), F.lit("...")).alias("t"))
    x = cut.select("obj_id", "fragment_index", "total_fragments", F.array_sort(F.collect_list(about).over(own)).alias("all"))
    others = F.filter("all", lambda s: s["fragment_index"] != F.col("fragment_index"))
    named = F.array_join(F.transform(others, lambda s: s["t"]), "; ")
    head = F.concat(F.lit(PIECE_OF), F.col("fragment_index"), F.lit("/"), F.col("total_fragments"), F.lit(" "))
    return x.select("obj_id", "fragment_index", F.concat(head, F.when(F.size(others) > 0, F.concat(F.lit(OTHERS), named)).otherwise("")).alias("context"))


def fragment_stats(expanded: DataFrame) -> DataFrame:
    """(doc_id, total_chunks, originals, fragments, fragmented_rows) per document."""
    return expanded.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(~F.col("is_fragment")).alias("originals"), F.count_if("is_fragment").alias("fragments"),
        F.count_distinct(F.when(F.col("fragment_index").isNotNull(), F.col("obj_id"))).alias("fragmented_rows"),
    )


def table_neighbours(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_pos, table_no, preceding_index, following_index, preceding, following, context) of each Word table:
    the nearest non-blank paragraph before it, and the one numbered next if there is one.

    Paragraphs are counted in stretches of a document, and found by their number, so a long document isn't one task's.
    """
    rows = blocks.groupBy("doc_id", "block_pos").agg(F.min("kind").alias("kind"), F.min("text").alias("text"), F.min("table_no").alias("table_no"))
    solid = (F.col("kind") == "paragraph") & shown(F.col("text"))
    rows = running(rows.where(solid | (F.col("kind") == "table")).withColumn("solid", solid), ["doc_id"], "block_pos", [], F.col("solid").cast("int"), "before")
    texts = rows.where("solid").select("doc_id", F.col("before").cast("long").alias("n"), "text")
    tables = rows.where("kind = 'table'").select("doc_id", "block_pos", "table_no", F.col("before").cast("long").alias("before"))
    pre = texts.select("doc_id", F.col("n").alias("before"), F.col("text").alias("preceding"))
    post = texts.select("doc_id", (F.col("n") - 1).alias("before"), F.col("text").alias("following"))
    x = tables.join(pre, ["doc_id", "before"], "left").join(post, ["doc_id", "before"], "left")
    context = F.concat(F.lit(BEFORE), or_empty(F.col("preceding")), F.lit(AFTER), or_empty(F.col("following")))
    return x.select(
        "doc_id", "block_pos", "table_no", F.when(F.col("before") > 0, F.col("before")).alias("preceding_index"),
        F.when(F.col("following").isNotNull(), F.col("before") + 1).alias("following_index"), "preceding", "following", context.alias("context"),
    )


def table_fragment_context(tables: DataFrame, paras: DataFrame, config: FragmentConfig = FragmentConfig()) -> DataFrame:
    """(doc_id, block_pos, context): table context with a long neighbouring paragraph given by its numbered fragments."""
    ids = paras.withColumn("obj_id", F.xxhash64("doc_id", "paragraph_index")).withColumn("chunk_type", F.lit("text")).withColumn("is_fragment", F.lit(False))
    piece = F.struct("fragment_index", F.concat(F.lit(f"[{PIECE}"), F.col("fragment_index"), F.lit("] "), F.col("content")).alias("t"))
    whole = fragments(ids, config).groupBy("obj_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["t"]), " ").alias("joined"))
    texts = ids.join(whole, "obj_id", "left").select("doc_id", "paragraph_index", F.coalesce("joined", "content").alias("t"))
    pre = texts.select("doc_id", F.col("paragraph_index").alias("preceding_index"), F.col("t").alias("pre"))
    post = texts.select("doc_id", F.col("paragraph_index").alias("following_index"), F.col("t").alias("post"))
    x = tables.select("doc_id", "block_pos", "preceding_index", "following_index").join(pre, ["doc_id", "preceding_index"], "left").join(post, ["doc_id", "following_index"], "left")
    return x.select("doc_id", "block_pos", F.concat(F.lit(BEFORE), or_empty(F.col("pre")), F.lit(AFTER), or_empty(F.col("post"))).alias("context"))
