"""Problem 3: splitting oversized items at natural boundaries, with overlap.

A text is split along a hierarchy of separators (section, paragraph, sentence, clause, word, character), one level
deeper only where a part is still over the limit; the parts are packed greedily into pieces, and each piece starts with
the tail of the one before, from a boundary inside the allowed overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import running, spread

LIMIT, OVERLAP = 500, 50
LEVELS = ("section", "paragraph", "sentence", "clause", "word", "character")
_BREAK = r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"
#: What starts a section's heading line: a mark-up sign, or a numbered chapter or section in one of the texts' languages.
_HEADING = r"[^\S\n\r]*(?:#{1,6}[^\S\n\r]|第[一二三四五六七八九十百零\d]{1,6}[章节篇部]|(?i:chapter|section|chapitre|partie)[^\S\n\r]+\d)"
#: What ends a part at each level; the separator stays with the part before it. A section ends at a blank line or before a heading.
_ENDS = [
    regex.compile(rf"(?:{_BREAK})[^\S\n\r]*(?:(?:{_BREAK})[^\S\n\r]*)+|(?:{_BREAK})(?={_HEADING})"),
    regex.compile(rf"(?:{_BREAK})+"),
    regex.compile(r"""(?:[。！？!?…]+|\.+(?=[\s"'”’」』）)\]]))["'”’」』）)\]]*\s*"""),
    regex.compile(r"[;；:：,，、|｜]+\s*|[)）\]】」』”]+\s*"),
    regex.compile(r"[\s\p{P}]"),
]
_FREE = regex.compile(r"[\s\p{P}]")


def _parts(text: str, start: int, end: int, limit: int, step: int, level: int, out: list[tuple[int, int, int]]) -> None:
    """Spans of at most ``limit``, each with the level of the boundary that it ends at."""
    if end - start <= limit:
        out.append((start, end, level))
        return
    if level == len(_ENDS):
        out.append((start, start + limit, level))  # the parts behind leave room for the overlap
        out.extend((at, min(end, at + step), level) for at in range(start + limit, end, step))
        return
    at = start
    for m in _ENDS[level].finditer(text, start, end):
        if m.end() > at:
            _one(text, at, m.end(), limit, step, level, out)
            at = m.end()
    if at < end:
        _one(text, at, end, limit, step, level, out)


def _one(text: str, start: int, end: int, limit: int, step: int, level: int, out: list[tuple[int, int, int]]) -> None:
    if end - start > limit and level == len(_ENDS) - 1 and end - start == limit + 1 and _FREE.match(text, end - 1):
        out.extend([(start, end - 1, level), (end - 1, end, level)])  # a stretch that just fits, then its mark
    else:
        if end - start <= limit:
            out.append((start, end, level))
        else:
            _parts(text, start, end, limit, step, level + 1, out)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, level) of each piece: code point span, characters shared with the piece before, level of the
    boundary at its end (``LEVELS``; the last piece ends at the text's end). Empty text has no piece.

    Spans cover the text without a gap and none is longer than ``limit``.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap less than it")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), 0, 0)]
    parts: list[tuple[int, int, int]] = []
    _parts(text, 0, len(text), limit, limit - overlap, 0, parts)
    out: list[tuple[int, int, int, int]] = []
    start, end, level, k = 0, 0, 0, 0
    shared = 0
    while k < len(parts):
        s, e, lv = parts[k]
        if end > start and e - start > limit and end > start + shared:
            out.append((start, end, shared, level))
            start, shared = _tail(text, start, end, e, limit, overlap, level), 0
            shared = end - start
            continue
        if e - start > limit:  # the tail leaves no room for the part
            start, shared = end, 0
        end, level, k = e, lv, k + 1
    out.append((start, end, shared, 0))
    return out


def _tail(text: str, start: int, end: int, next_end: int, limit: int, overlap: int, level: int) -> int:
    """Where the piece after ``end`` starts: after the highest boundary within the overlap that leaves room for the next part."""
    lo = max(end - overlap, next_end - limit, start + 1)
    if lo >= end:
        return end
    if level == len(_ENDS):
        return lo
    for pattern in _ENDS[1:]:
        for m in pattern.finditer(text, max(start, lo - 4), end):
            if lo <= m.end() < end:
                return m.end()
    return end


def _split_batches(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                src, cols = [], [[] for _ in range(7)]
                for i, t in enumerate(b.column("text").to_pylist()):
                    for n, (s, e, shared, level) in enumerate(split(t, limit, overlap), 1):
                        src.append(i)
                        for c, v in zip(cols, (n, s, e, shared, LEVELS[level], int(level == len(_ENDS)), t[s:e] if with_text else None)):
                            c.append(v)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(src, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                    names=["id", "piece_no", "start_pos", "end_pos", "overlap", "level", "forced", "piece"],
                )

    return run


PIECES = "id long, piece_no int, start_pos int, end_pos int, overlap int, level string, forced int, piece string"


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, overlap, level, forced, piece) of each row whose text has more than ``limit`` code points.

    Null, empty and shorter texts need no cut and give no row; a repeated row is cut each time. ``forced`` is 1 for a
    piece that ends inside a stretch without any blank, line break or punctuation mark.
    """
    rows = spread(df.where(F.length(text) > limit).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    return rows.mapInArrow(_split_batches(limit, overlap, with_text), PIECES)


def numbered(df: DataFrame, key: str, text: str, doc: str, paragraph: str, order: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``pieces`` with ``number``, counted on through the rows of one paragraph of a document.

    ``order`` starts with a whole number. A row without a document or paragraph is numbered by itself. Only counts are gathered by paragraph, not texts.
    """
    cut = pieces(df, key, text, limit, overlap)
    count = cut.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    place = df.where(F.length(text) > limit).select(F.col(key).cast("long").alias("id"), F.col(doc).alias("doc"), F.col(paragraph).alias("para"), *order).dropDuplicates(["id"])
    alone = F.when(F.col("doc").isNull() | F.col("para").isNull(), F.col("id"))
    upto = running(place.join(count, "id").withColumn("alone", alone), ["doc", "para", "alone"], order[0], [*order[1:], "id"], F.col("n"), "upto")
    offset = upto.select("id", "para", (F.col("upto") - F.col("n")).alias("before"))
    return cut.join(offset, "id").withColumn("number", (F.col("before") + F.col("piece_no")).cast("int")).drop("before")
