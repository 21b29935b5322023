"""Several values packed in one field: one row per value, under the dialect of minimum description length.

A dialect is a set of delimiters with or without quoting (``functions.packed``); without costs a field is one value. Under a
dialect a field costs what its values cost in a code learnt from the whole corpus: a value that the corpus holds n times among
N costs log2(N / n) bits, a new one an escape and its characters; and what the corpus never does, a separator left inside a
value or a quote mark that encloses nothing, costs as much as such rare events do by the number of characters seen. The code
is counted in a first pass over all fields; values of at most 17 bits are its dictionary, which therefore has at most 2^17
entries and is broadcast. In a second pass every field comes out under its cheapest dialect. Texts are never shuffled, only
counts are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import packed
from docloom.runtime import spread, written

#: Bits of the escape to a new value and of one of its characters; the dictionary holds values of at most so many bits.
ESCAPE_BITS, CHAR_BITS, DICTIONARY_BITS = 12.0, 6.0, 17
#: Characters that count as seen before the corpus is, without a separator inside a value among them.
PRIOR_CHARS = 1 << 22
#: Fields whose chosen dialect a worker remembers, as fields repeat.
REMEMBERED = 20_000
_NON_BLANK = r"[^\s\p{Z}]"


def long_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) for each non-blank field; nulls and blanks yield no row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        df.select(F.col(key), F.explode(pairs).alias("x")).select(key, "x.field", "x.value").where(F.col("value").rlike(_NON_BLANK))
    )


def _hash(field: str, item: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{field}\0{item}".encode("utf-8", "surrogatepass")) - (1 << 63)


class Code:
    """What values cost, in bits."""

    def __init__(self, dictionary: dict[int, float], chars: int):
        self.dictionary = dictionary
        self.surprise = math.log2(2 * (chars + PRIOR_CHARS))

    def value(self, field: str, item: str, quoted: bool) -> float:
        if not item:
            return 0.0
        odd = packed.surprises(item, quoted)
        new = ESCAPE_BITS + CHAR_BITS * len(item) + self.surprise * odd
        return new if odd else min(new, self.dictionary.get(_hash(field, item), new))

    def parse(self, field: str, items: list[tuple[str, bool]], bound: float = math.inf) -> float:
        """The cost of a field parsed into these items; or a part of it that is over ``bound``."""
        cost = 0.0
        for x, quoted in items:
            if cost > bound:
                break
            cost += self.value(field, x, quoted)
        return cost


def chosen(code: Code | None, field: str, value: str, marks: bool, every: bool = False) -> tuple[int, str | packed.Dialect, list[tuple[str, bool]]]:
    """The rank, the dialect and the items of a field's cheapest parse, of equal ones the first; rank 0 is the list or the finest
    dialect. The search goes from the finest dialect one switch (a delimiter, quotes, numbers) at a time as long as that saves
    bits; with ``every``, over all candidates. Without a code nothing is cheaper than a field as one value.

    Where quotes and numbers play no part, a dialect of fewer delimiters only leaves separators inside values. Each costs a
    surprise and a character and saves at most an escape, which is less, so the finest dialect is the cheapest
    and the others aren't parsed.
    """
    if code is None:
        return 0, packed.NAMED["whole"], [(value.strip(), False)]
    if every:
        costs = [(round(code.parse(field, items), 6), rank, d, items) for rank, (d, items) in enumerate(packed.candidates(value, marks))]
        return min(costs, key=lambda c: c[:2])[1:]
    listed, finest = packed.parse_list(value), packed.NAMED["plain"]
    values = packed.parse_values(value, finest, marks)
    best = 0, finest, [(v.item, v.quoted) for v in values]
    if listed is None and code.surprise + CHAR_BITS > ESCAPE_BITS and packed.simple(value):
        return best
    least = code.parse(field, best[2])
    if listed is not None:
        items = [(x, True) for x in listed]
        cost = code.parse(field, items)
        best, least = ((0, "list", items), cost) if cost <= least else ((1, *best[1:]), least)
    better = best[1] != "list"
    while better:  # one switch at a time, to the cheapest, while any saves bits
        better = False
        for d in packed.neighbours(best[1], value):
            items = [(v.item, v.quoted) for v in packed.parse_values(value, d, marks)]
            cost = code.parse(field, items, least)
            if cost < least - 1e-6:
                best, least, better = (2, d, items), cost, True
    return best


def _counted(marked: frozenset[str]):
    """(field, value) to (item, n, chars): how often a batch's finest parses hold each value, and the characters of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                items = packed.parse_list(v)
                seen.update((f, x) for x in (packed.parse(v, "plain", f in marked) if items is None else items) if x)
            cols = [pa.array([_hash(f, x) for f, x in seen], pa.int64()), pa.array(seen.values(), pa.int64()), pa.array([n * len(x) for (_, x), n in seen.items()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "n", "chars"])

    return run


def learnt(values: DataFrame, marked: frozenset[str] = frozenset()) -> Code:
    """The code of a corpus (field, value): its counts over all fields, of which the driver gets the bounded dictionary."""
    counts = values.select("field", "value").mapInArrow(_counted(marked), "item long, n long, chars long").groupBy("item").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    counts = written(counts, "packed-counts")
    total, chars = counts.agg(F.sum("n"), F.sum("chars")).first()
    if not total:
        return Code({}, 0)
    known = counts.where(F.col("n") > 1).where(F.col("n") * (1 << DICTIONARY_BITS) >= total).select("item", "n").collect()  # 2^17 rows at most
    return Code({r["item"]: math.log2(total / r["n"]) for r in known}, chars)


class _Remembered:
    """``chosen`` with the last fields' results kept, as fields repeat."""

    def __init__(self, code: Code, marked: frozenset[str]):
        self.code, self.marked, self.kept = code, marked, {}

    def __call__(self, field: str, value: str) -> tuple:
        got = self.kept.get((field, value))
        if got is None:
            if len(self.kept) >= REMEMBERED:
                self.kept.clear()
            got = self.kept[field, value] = chosen(self.code, field, value, field in self.marked)
        return got


def dialects(values: DataFrame, marked: frozenset[str] = frozenset()) -> DataFrame:
    """(vh, dialect) of each distinct (field, value) whose cheapest parse isn't its first, that of the list or of the finest dialect."""
    shared = values.sparkSession.sparkContext.broadcast(learnt(values, marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _Remembered(shared.value, marked)
        for b in batches:
            got = [(h, choose(f, v)) for f, v, h in zip(*(b.column(i).to_pylist() for i in range(3)))]
            got = [(h, f"{'+'.join(sorted(d.delimiters))}{' literal quotes' * (not d.quotes)}{' bare numbers' * (not d.numbers)}") for h, (rank, d, _) in got if rank]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.int64()), pa.array([d for _, d in got], pa.string())], names=["vh", "dialect"])

    rows = values.select("field", "value").distinct().withColumn("vh", F.xxhash64("field", "value"))
    return rows.mapInArrow(run, "vh long, dialect string")


def _parsed(shared, marked: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _Remembered(shared.value, marked)
        for b in batches:
            src, pos, item = [], [], []
            for i, (f, v) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for k, (x, _) in enumerate(choose(f, v)[2], 1):
                    if x:
                        src.append(i), pos.append(k), item.append(x)
            at = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(item, pa.string())], names=["key", "field", "pos", "item"])

    return run


def unpack(df: DataFrame, key: str, fields: list[str], marked: frozenset[str] = frozenset(), costs: bool = True) -> DataFrame:
    """(key, field, pos, item): one row per non-empty value of each field.

    ``pos`` starts at 1 and counts empty places. Null and blank fields, and tables without rows, give no rows;
    repeated rows are unpacked each; ``marked`` names fields whose values may carry a bullet or running number.
    Only ``key`` and ``fields`` are read, so other columns may have any name. Without ``costs`` no dialect beats the
    trivial one, and every field is one value.
    """
    values = long_fields(spread(df.select(key, *fields)), key, fields)
    shared = df.sparkSession.sparkContext.broadcast(learnt(values, marked) if costs else None)  # 2^17 entries at most
    rows = values.select(F.col(key).alias("key"), "field", "value")
    out = rows.mapInArrow(_parsed(shared, marked), f"key {rows.schema['key'].dataType.simpleString()}, field string, pos int, item string")
    return out.withColumnRenamed("key", key)
