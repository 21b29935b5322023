"""Problem 8: per-document text statistics, and rules on them that tell prose from lists, tables and junk.

Characters are classed, and runs of characters counted, in arrays over many texts at once; lines are read once each. Beside
the usual figures (words, symbols, line ends, common words) there are repetition figures: duplicate lines and paragraphs, and
the share of the characters that the occurrences of the most frequent run cover, for runs of several lengths.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread

#: Lengths of runs whose dominant one is measured, powers of two; the distinct share is that of runs of NGRAM.
NGRAMS, NGRAM = (4, 8, 16), 8
#: Characters taken together; a longer text is taken by itself.
CHARS_AT_ONCE = 1 << 20
STATS = {
    "n_chars": "int", "word_count": "int", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double",
    "common_share": "double", "line_count": "int", "ended_lines": "double", "sentence_marks": "double", "short_lines": "double",
    "entry_share": "double", "row_share": "double", "sentence_share": "double", "trace_share": "double", "noise_ratio": "double",
    "damaged_ratio": "double", "rare_ideographs": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double",
    "dominant_4gram": "double", "dominant_ngram": "double", "dominant_16gram": "double", "distinct_ngrams": "double", "distinct_words": "double", "longest_word": "int",
}

_WORD = re.compile(r"[A-Za-z\u00c0-\u024f]+")
_LONG = re.compile(r"[A-Za-z0-9+/=_\-]{25,}")
_FULL_STOPS = frozenset("。！？!?…")
_SENTENCE = re.compile(r"[。！？!?]|[a-z\u00c0-\u024f0-9%)]\.(?:\s|$)")
_MARKER = re.compile(r"\s*(?:[•●▪■◆○□·*–—\-]\s|\[[ xX✓]?\]|[☐☑☒✓✔]|[(（]?\d{1,4}[)）.、:：]\s?(?!\d)|[(（]?[一二三四五六七八九十百]{1,4}[)）、.]|[①-⑳]|[(（]?[a-zA-Z][)）.]\s)")
_LEADER = re.compile(r"(?:\.{4,}|…{2,}|·{4,}|_{4,}|(?:\. ){3,})\s*\d{1,5}\s*$")
_GAP = re.compile(r"\S[ \u3000]{2,}(?=\S)|\t+")
_PAIR = re.compile(r"(?:^|[\s;；,，|])[^\s=：:;；,，|]{1,40}(?: [^\s=;；,，|]{1,20}){0,4}=")
_BORDER = re.compile(r"\s*[+|¦│┌└├─═╔╚╠┬┴┼\-=:\s]{5,}\s*$")
_CELL = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b", re.I)
_TRACE = re.compile(
    r"\s*(?:\[?(?:DEBUG|TRACE|WARN|WARNING|INFO|ERROR|FATAL)\]?[\s:]|0x[0-9a-fA-F]{4,}|at [\w.$<>]+\(|Traceback |File \"|\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[.,]\d+\s|[0-9a-fA-F]{6,8}[: ]\s*(?:[0-9a-fA-F]{2} ){4})"
)
_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]+")
_LINES = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+")
_PARAGRAPHS = re.compile(r"\n\s*\n")
_PIECES = re.compile(r"[\u3400-\u9fff]+|\d+")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Class of each code point: 1 letter, 2 ideograph of the common set, 3 other ideograph, 4 digit, 5 blank, 6 punctuation, 7 symbol, 8 noise mark, 9 damage."""
    t = np.zeros(0x110000, np.uint8)
    kinds = {"L": 1, "M": 1, "N": 4, "Z": 5, "P": 6, "S": 7}
    for cp in range(0x30000):
        cat = unicodedata.category(chr(cp))
        t[cp] = kinds.get(cat[0], 9 if cat in ("Cc", "Co", "Cn", "Cs") else 0)
    for a, b in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        t[a:b] = 3
    for row in range(0xB0, 0xD8):  # the first level of the national character set holds the common ideographs
        for cell in range(0xA1, 0xFF):
            try:
                t[ord(bytes((row, cell)).decode("gb2312"))] = 2
            except UnicodeDecodeError:
                pass
    for ch in "\t\n\r\x0b\x0c\x85\u2028\u2029":
        t[ord(ch)] = 5
    for ch in "~^_`¬§¤¶":  # marks that damaged recognition leaves and that neither prose nor tables use
        t[ord(ch)] = 8
    t[0xFFFD] = 9
    return t


def _line_kind(line: str, fields: int, inner: int, ended: bool) -> str:
    """entry, row, trace, sentence or other, for one non-blank line of ``inner`` sentence marks, ``ended`` by one or not;
    ``fields``: the usual comma fields of the text. Cheap tests stand before the patterns that they imply."""
    n = len(line)
    if _TRACE.match(line):
        return "trace"
    if n > 8 and _BORDER.match(line) or "<" in line and _CELL.search(line):
        return "row"
    if line.count("|") + line.count("¦") + line.count("│") >= 2:
        return "row"
    bare = line.strip()
    if n < 160 and bare[-1].isdigit() and _LEADER.search(line):
        return "entry"
    if "\t" in bare or "  " in bare or "\u3000" in bare:
        gaps = len(_GAP.findall(bare))
        if gaps >= 2 or "\t" in bare and gaps:
            return "row"
    if line.count("=") >= 2 and len(_PAIR.findall(line)) >= 2:
        return "row"
    if not inner and fields >= 3 and line.count(",") + line.count(";") >= 2 and _csv_fields(line) == fields:
        return "row"
    room = _room(line)
    if _MARKER.match(line) and n <= room and inner <= 1 and not (ended and n > 0.45 * room):
        return "entry"
    if inner or ended:
        return "sentence"
    if n <= 0.6 * room:
        return "entry"
    return "other"


def _room(line: str) -> float:
    """The most characters of an entry: 110 in alphabetic script, 50 in ideographs (two more bytes each)."""
    n = len(line)
    return 110 - 60 * min(1.0, (len(line.encode("utf-8", "surrogatepass")) - n) / (2 * n))


def _wrapped(lines: list[str], kinds: list[str]) -> None:
    """Lines of running text that a fixed width has cut count as sentences: many lines hold a sentence mark, and the others are about as long."""
    free = [i for i, k in enumerate(kinds) if k in ("entry", "sentence", "other") and not _MARKER.match(lines[i])]
    marked = sum(kinds[i] == "sentence" for i in free)
    if marked < 2 or marked < 0.2 * len(free):
        return
    widths = sorted(len(lines[i]) for i in free)
    width = widths[int(0.8 * (len(widths) - 1))]
    for i in free:
        if kinds[i] != "sentence" and len(lines[i]) >= 0.6 * width:
            kinds[i] = "sentence"


def _csv_fields(line: str) -> int:
    if '"' not in line:
        return max(line.count(","), line.count(";")) + 1
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(bare.count(","), bare.count(";")) + 1


def _repetition(codes: np.ndarray, owner: np.ndarray, texts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of NGRAMS, per text: the characters that the most frequent run's occurrences cover (none if it occurs
    once), and the share of its runs that are distinct. Runs are known by a 44-bit hash; of equally frequent ones one counts."""
    out, h, step = {}, codes.astype(np.uint64), 1
    wide, lens, none = owner.astype(np.uint64) << np.uint64(44), np.bincount(owner, minlength=texts), np.uint64(0xFFFFFFFFFFFFFFFF)
    while step < max(NGRAMS):
        h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(29))) if len(h) > step else h[:0]
        step *= 2
        if step not in NGRAMS:
            continue
        covered, distinct = np.zeros(texts, np.int64), np.ones(texts)
        own = owner[: len(h)]
        key = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)) | wide[: len(h)]
        across = own != owner[step - 1 :] if len(h) else np.zeros(0, bool)
        key[across] = none  # runs over the end of a text
        ranked = np.sort(key)[: len(key) - int(across.sum())]
        if len(ranked):
            new = np.ones(len(ranked), bool)
            np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
            at = np.flatnonzero(new)
            count = np.diff(at, append=len(ranked))
            text = (ranked[at] >> np.uint64(44)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            most = np.zeros(texts, np.int64)
            most[text[first]] = np.maximum.reduceat(count, first)
            top = np.flatnonzero((count == most[text]) & (count > 1))
            best = np.full(texts, none - np.uint64(1))
            best[text[top]] = ranked[at[top]]  # the last one of a tie
            spots = np.flatnonzero(key == best[own])
            room = np.full(len(spots), step)
            same = owner[spots[1:]] == owner[spots[:-1]]
            room[:-1][same] = np.minimum(step, np.diff(spots)[same])
            covered = np.bincount(owner[spots], weights=room, minlength=texts).astype(np.int64)
            distinct[text[first]] = np.diff(first, append=len(text)) / (lens[text[first]] - step + 1)
        out[step] = covered, distinct
    return out


def stats(text: str, common: frozenset[str]) -> dict:
    """The figures of one text that isn't blank. ``common``: very frequent words of all languages in lower case."""
    return stats_of([text], common)[0]


def stats_of(texts: list[str], common: frozenset[str]) -> list[dict]:
    """The figures of texts that aren't blank."""
    lens = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lens)
    kinds = np.bincount(owner * 10 + _tables()[codes], minlength=10 * len(texts)).reshape(-1, 10)
    hits = np.bincount(owner, weights=_common_table(common)[codes], minlength=len(texts)).astype(np.int64)
    latin = np.bincount(owner, weights=(codes >= 0xC2) & (codes <= 0xF4), minlength=len(texts)) > 0  # may hold broken encoding
    repeated = _repetition(codes, owner, len(texts))
    out = []
    for i, text in enumerate(texts):
        grams = {k: (float(covered[i]) / len(text), float(distinct[i])) for k, (covered, distinct) in repeated.items()}
        out.append(_figures(text, common, kinds[i], int(hits[i]), bool(latin[i]), grams))
    return out


def _ended(line: str) -> bool:
    """Whether a line ends with a sentence mark, closing quotes and brackets behind it aside; a dot counts once, not after a blank."""
    line = line.rstrip()
    if line.rstrip("\"'”’」』）)")[-1:] in _FULL_STOPS:
        return True
    line = line.rstrip("\"'”’)")
    return line[-1:] == "." and (len(line) == 1 or line[-2] != "." and not line[-2].isspace())


def _figures(text: str, common: frozenset[str], kinds: np.ndarray, hits: int, latin: bool, grams: dict[int, tuple[float, float]]) -> dict:
    shown = max(1, int(len(text) - kinds[5]))
    words = _WORD.findall(text)
    lower = [w.lower() for w in words]
    ideographs = int(kinds[2] + kinds[3])
    hits += sum(map(common.__contains__, lower))
    units = len(words) + ideographs
    lines = [x for x in _LINES.split(text) if x.strip()]
    fields = Counter(_csv_fields(x) for x in lines if "," in x or ";" in x).most_common(1)
    usual = fields[0][0] if fields and fields[0][1] >= 2 and fields[0][1] >= 0.4 * len(lines) else 0
    inner = [len(_SENTENCE.findall(x)) for x in lines]
    ends = list(map(_ended, lines))
    kinds_of = [_line_kind(x, usual, k, e) for x, k, e in zip(lines, inner, ends)]
    _wrapped(lines, kinds_of)
    share, total = Counter(), sum(map(len, lines))
    for k, x in zip(kinds_of, lines):
        share[k] += len(x)
    short = sum(len(x) <= 30 for x in lines)
    longest = max(map(len, text.split()), default=0)
    paragraphs = [x.strip() for x in _PARAGRAPHS.split(text) if x.strip()]
    stripped = [x.strip() for x in lines]
    broken = (sum(len(x) for x in _MOJIBAKE.findall(text)) if latin else 0) + int(kinds[9])
    pieces = [*lower, *_PIECES.findall(text)]
    strings = sum(map(len, _LONG.findall(text))) if longest >= 25 and not share["trace"] else 0
    return {
        "n_chars": len(text), "word_count": units, "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": float(kinds[7] + kinds[8] + kinds[6]) / shown, "digit_ratio": float(kinds[4]) / shown, "common_share": hits / max(1, units),
        "line_count": len(lines), "ended_lines": sum(ends) / len(lines), "sentence_marks": 100 * sum(inner) / len(text), "short_lines": short / len(lines),
        "entry_share": share["entry"] / total, "row_share": share["row"] / total, "sentence_share": share["sentence"] / total,
        "trace_share": (share["trace"] + strings) / total,
        "noise_ratio": float(kinds[8]) / shown, "damaged_ratio": broken / shown, "rare_ideographs": float(kinds[3]) / max(1, ideographs),
        "duplicate_lines": 1 - len(set(stripped)) / len(stripped), "duplicate_paragraphs": 1 - len(set(paragraphs)) / len(paragraphs),
        "dominant_4gram": grams[4][0], "dominant_ngram": grams[8][0], "dominant_16gram": grams[16][0], "distinct_ngrams": grams[NGRAM][1],
        "distinct_words": len(set(pieces)) / max(1, len(pieces)), "longest_word": longest,
    }


@lru_cache(maxsize=4)
def _common_table(common: frozenset[str]) -> np.ndarray:
    t = np.zeros(0x110000, bool)
    for w in common:
        if len(w) == 1 and "\u3400" <= w <= "\u9fff":
            t[ord(w)] = True
    return t


def kind(s: dict) -> str:
    """prose, list, table or junk, from the figures of one text; the shares of line kinds and the repetition figures together."""
    rows, entries, sentences = s["row_share"], s["entry_share"], s["sentence_share"]
    if s["damaged_ratio"] > 0.02 or s["trace_share"] > 0.5 or s["noise_ratio"] > 0.06:
        return "junk"  # broken encoding, machine traces, damaged recognition
    if s["rare_ideographs"] > 0.5 and s["common_share"] < 0.05 and rows < 0.5:
        return "junk"  # random ideographs
    if s["symbol_ratio"] > 0.9 or s["mean_word_length"] > 30 and sentences < 0.5:
        return "junk"  # signs only, or random strings
    if s["n_chars"] >= 40 and (s["distinct_ngrams"] < 0.12 or max(s["dominant_4gram"], s["dominant_ngram"], s["dominant_16gram"]) > 0.85):
        return "junk"  # endless repetition: few runs of characters, or one that covers nearly all
    if s["distinct_words"] < 0.3 and s["digit_ratio"] < 0.03 and sentences < 0.3 and entries < 0.5:
        return "junk"  # the same few words over and over: page furniture
    if s["duplicate_lines"] > 0.5 and s["line_count"] * (1 - s["duplicate_lines"]) <= 15 and s["distinct_words"] < 0.35 and rows < 0.5:
        return "junk"
    if s["duplicate_paragraphs"] > 0.7 and s["dominant_16gram"] > 0.4 and rows < 0.5:
        return "junk"  # a few paragraphs over and over: boilerplate
    if s["line_count"] == 1 and rows > 0.5 and s["digit_ratio"] < 0.03:
        return "junk"  # words set apart, but no rows
    if sentences >= 0.5:
        return "prose"
    if rows >= 0.35 and rows >= entries:
        return "table"
    if entries >= 0.35:
        return "list"
    if s["short_lines"] >= 0.8 and s["ended_lines"] < 0.2 and s["line_count"] >= 5 and s["duplicate_lines"] < 0.5:
        return "list"  # mixed short lines
    if s["word_count"] == 0 and rows < 0.2 or sentences < 0.2 and s["sentence_marks"] < 0.1 and s["n_chars"] > 60:
        return "junk"  # heaps of words without sentences, or none
    return "prose"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHARS_AT_ONCE characters, a row at least."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        upto, at = np.cumsum(pc.utf8_length(b.column(1)).to_numpy()), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARS_AT_ONCE, side="right")))
            yield b.slice(at, to - at)
            at = to


def _stat_batches(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "double": pa.float64()}
        for b in _spans(batches):
            rows = stats_of(b.column(1).to_pylist(), common)
            cols = [pa.array([r[k] for r in rows], types[v]) for k, v in STATS.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([kind(r) for r in rows], pa.string())], names=["id", *STATS, "doc_kind"])

    return run


def text_stats(df: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """(<key>, figures, doc_kind) of each row with a text that shows something; null, empty and blank texts give no row.

    ``common_words`` (word) is a short, fixed list and is read on the driver. Repeated rows give one row each.
    """
    common = frozenset(r[0].lower() for r in common_words.where("word IS NOT NULL").select("word").distinct().collect())
    rows = spread(df.where(F.col(text).rlike(r"[^\s\p{Z}]")).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    schema = "id long, " + ", ".join(f"{k} {v}" for k, v in STATS.items()) + ", doc_kind string"
    return rows.mapInArrow(_stat_batches(common), schema).withColumnRenamed("id", key)
