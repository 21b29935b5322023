"""Retrieval for batches of questions: exact vector search, BM25 keyword search, their fusion, and formatting of hits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import shown
from docloom.runtime import spread, written

K1, B, ALPHA = 1.2, 0.75, 0.4
DIGITS = 6
QUERY_BLOCK = 1024
#: So many rows of the corpus are scored at once against a block of queries.
ROW_BLOCK = 2048
#: So many (question, row, term) meetings are added up at once.
MEETINGS_AT_ONCE = 1 << 20
#: So many queries, of so many terms and numbers of vectors, are asked at once by ``hybrid_full``, in tiles of so many.
ASKED_AT_ONCE, VALUES_AT_ONCE, TILE_QUERIES = 32_768, 1 << 22, 128
#: Up to so many query terms are broadcast; beyond, they are joined by shuffle.
BROADCAST_TERMS = 200_000


def top_k(scored: DataFrame, query: str, score: str, tie: str, k) -> DataFrame:
    """``scored`` with hit_rank, the best ``k`` of each query, higher scores first, ties by ``tie``."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    return scored.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= limit)


def _best(score: np.ndarray, may: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores among those that ``may`` count, all ties of the last one included."""
    best = np.flatnonzero(may)
    if k <= 0:
        return best[:0]
    if len(best) > k:
        own = score[best]
        best = best[own >= np.partition(own, len(best) - k)[len(best) - k]]
    return best


def _nearest_batches(shared):
    """The k best of every query within each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        for b in _pieces(batches):
            rows, score, may = block.cosine(b)
            best = [_best(score[q], may[q], block.k[q]) for q in range(len(block.qids))]
            q, r = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate([np.zeros(0, np.int64), *best])
            yield pa.RecordBatch.from_arrays([pa.array(block.qids[q]), b.column(0).take(pa.array(rows[r])).cast(pa.int64()), pa.array(score[q, r])], names=["qid", "id", "score"])

    return run


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The queries, a stated set, in blocks of QUERY_BLOCK and of one length of vectors each."""
    rows = queries.toLocalIterator()
    while some := list(islice(rows, QUERY_BLOCK)):
        by_length: dict[int, list] = {}
        for r in some:
            by_length.setdefault(len(r["vector"] or ()), []).append(r)
        yield from by_length.values()


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 10, most: float | None = None, same: str | None = None) -> DataFrame:
    """(qid, hit_rank, id, distance): the k nearest by cosine distance, ties by id; only then those beyond ``most`` are dropped.

    The queries (qid, vector) are a stated set; they are taken in blocks of QUERY_BLOCK, broadcast, and each block goes once over the
    corpus (id, vector), of which a batch sends on its own k best per query. ``same`` names a column that must be equal.
    Null vectors and vectors of another length match nothing; a vector of no length scores 0.
    """
    names, row = ["vector", *([same] if same else [])], "qid long, id long, score double"
    asked = queries.where("vector IS NOT NULL").select("qid", *names, F.lit(k).alias("k"))
    sc, rows = corpus.sparkSession.sparkContext, spread(corpus.select("id", *names))
    out = [rows.mapInArrow(_nearest_batches(sc.broadcast(_Block(some, same))), row) for some in _blocks(asked)]
    scored = reduce(DataFrame.union, out) if out else corpus.sparkSession.createDataFrame([], row)
    hits = top_k(scored, "qid", "score", "id", k)
    hits = hits.select("qid", "hit_rank", "id", F.round(1 - F.col("score"), DIGITS).alias("distance"))
    return hits if most is None else hits.where(F.col("distance") <= most)


def terms(text) -> Column:
    """Lower-case runs of letters and digits, and pairs of neighbouring ideographs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    return F.concat(words, F.regexp_extract_all(low, F.lit("(?=([\\x{4e00}-\\x{9fff}]{2}))"), 1))


class _Asked:
    """A block of questions (qid, t, k, and the columns that must be equal) as arrays: their terms, and who asks for each."""

    def __init__(self, rows: list, part: list[str]):
        self.qids = np.array([r["qid"] for r in rows], np.int64)
        self.k = np.array([r["k"] for r in rows], np.int64)
        self.codes = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in part) for r in rows if None not in [r[c] for c in part]))}
        self.kinds = np.array([self.codes.get(tuple(r[c] for c in part), -2) for r in rows], np.int64)
        place: dict[str, int] = {}
        pairs = [(place.setdefault(t, len(place)), q) for q, r in enumerate(rows) for t in r["t"]]
        term, self.who = (np.array(x, np.int64) for x in zip(*sorted(pairs))) if pairs else (np.zeros(0, np.int64),) * 2
        self.terms = pa.array(place, pa.string())
        self.first = np.searchsorted(term, np.arange(len(place) + 1))
        self.idf = np.zeros(len(place))

    def weigh(self, n: int, found: dict[str, int]) -> None:
        df = np.array([found.get(t, 0) for t in self.terms.to_pylist()], np.float64)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def scores(self, b: pa.RecordBatch, mean: float, part: list[str]) -> np.ndarray:
        """Questions x rows of a batch: their scores, 0 where no term (t) is shared or a column differs."""
        size = pc.fill_null(pc.list_value_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(pc.index_in(b.column("t").flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), size)[code >= 0]
        spot, tf = np.unique(row * max(1, len(self.terms)) + code[code >= 0], return_counts=True)
        row, code = np.divmod(spot, max(1, len(self.terms)))
        w = self.idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
        own = np.array([self.codes.get(x, -1) for x in zip(*(b.column(c).to_pylist() for c in part))], np.int64) if part else np.zeros(b.num_rows, np.int64)
        out = np.zeros(len(self.qids) * b.num_rows)
        many = self.first[code + 1] - self.first[code]
        upto, at = np.cumsum(many), 0
        while at < len(code):  # so many (question, row, term) at a time
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS_AT_ONCE, side="right")))
            of = np.repeat(np.arange(at, to), many[at:to])
            who = self.who[self.first[code[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])]
            if part:
                same = self.kinds[who] == own[row[of]]
                of, who = of[same], who[same]
            out += np.bincount(who * b.num_rows + row[of], weights=w[of], minlength=len(out))
            at = to
        return np.round(out.reshape(len(self.qids), b.num_rows), DIGITS)


def _bm25_batches(shared, mean: float, part: list[str], best: bool):
    """Rows (id, ..., t) to (qid, id, score): of every question all that share a term, or its k best within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Asked = shared.value
        for b in _pieces(batches):
            score = block.scores(b, mean, part)
            if best:
                some = [_best(score[q], score[q] > 0, block.k[q]) for q in range(len(score))]
                q, r = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate([np.zeros(0, np.int64), *some])
            else:
                q, r = np.nonzero(score)
            yield pa.RecordBatch.from_arrays([pa.array(block.qids[q]), b.column(0).take(pa.array(r)).cast(pa.int64()), pa.array(score[q, r])], names=["qid", "id", "score"])

    return run


def bm25_scores(queries: DataFrame, corpus: DataFrame, part: list[str] | None = None, k: int | str | None = None) -> DataFrame:
    """(qid, id, score) of questions (qid, text) and corpus (id, text) that share a term; with ``k`` those of each batch's k best
    of a question (``k`` may name a column of the questions).

    The questions are a stated set, taken in blocks of QUERY_BLOCK, broadcast. A first pass over the corpus counts the documents, their mean length
    and those that hold each term asked for; a second one scores every document where it is, so neither texts nor postings
    move, however frequent a term is. ``part`` names columns that must be equal, such as a knowledge base. An empty side
    gives no row.
    """
    part, row, spark = part or [], "qid long, id long, score double", corpus.sparkSession
    cut = spread(corpus.select("id", *part, "text")).select("id", *part, terms(F.col("text")).alias("t"))
    limit = F.lit(0) if k is None else F.col(k) if isinstance(k, str) else F.lit(k)
    asked = written(queries.select("qid", *part, F.array_distinct(terms(F.col("text"))).alias("t"), F.coalesce(limit, F.lit(0)).cast("int").alias("k")), "asked")
    stats, rows, out = _Statistics(cut, asked), asked.toLocalIterator(), []
    while stats.n and (some := list(islice(rows, QUERY_BLOCK))):
        block = stats.weighed(_Asked(some, part))
        out.append(cut.mapInArrow(_bm25_batches(spark.sparkContext.broadcast(block), stats.mean, part, k is not None), row))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], row)


class _Statistics:
    """Documents of a corpus (t), their mean length, and those that hold each term asked for (t), from one pass; no document
    counts where no term is asked for."""

    EVERY = "\0"  # stands for a term that every document holds

    def __init__(self, cut: DataFrame, asked: DataFrame):
        self.n, self.mean, spark = 0, 1.0, cut.sparkSession
        wanted = asked.select(F.explode("t").alias("term")).distinct()
        many = wanted.count()
        if many == 0:
            return
        wanted = wanted.union(spark.createDataFrame([(self.EVERY,)], "term string"))
        wanted = F.broadcast(wanted) if many <= BROADCAST_TERMS else wanted
        held = cut.where("t IS NOT NULL").select(F.size("t").alias("size"), F.explode(F.array_append(F.array_distinct("t"), F.lit(self.EVERY))).alias("term"))
        self.df = written(held.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("sizes")), "df")
        every = self.df.where(F.col("term") == self.EVERY).first()
        if every is not None:
            self.n, self.mean = every["df"], every["sizes"] / every["df"] or 1.0

    def weighed(self, block: _Asked) -> _Asked:
        """The block with the weights of its own terms."""
        if self.n:
            own = self.df.join(F.broadcast(self.df.sparkSession.createDataFrame([(t,) for t in block.terms.to_pylist()], "term string")), "term").select("term", "df")
            block.weigh(self.n, dict(own.toLocalIterator()))
        return block


def bm25_search(queries: DataFrame, corpus: DataFrame, k: int | str = 10, part: list[str] | None = None) -> DataFrame:
    """The best ``k`` of each question; ``k`` may name a column of the questions, one row each."""
    scored = bm25_scores(queries, corpus, part, k)
    scored = scored.join(queries.select("qid", F.col(k).alias("k")), "qid") if isinstance(k, str) else scored
    return top_k(scored, "qid", "score", "id", "k" if isinstance(k, str) else k).select("qid", "hit_rank", "id", "score")


def above(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``hits`` without those below their question's ``threshold``; a null one drops none."""
    return hits.join(questions.select("qid", "threshold"), "qid").where("threshold IS NULL OR score >= threshold").drop("threshold")


def fused(vector: DataFrame, keyword: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(qid, id, score): alpha x cosine + (1 - alpha) x BM25, each scaled to 0..1 within its question.

    A side that misses a row counts 0; where all of a side's scores are equal, they count 1.
    """

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.groupBy("qid").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        return df.join(ends, "qid").select("qid", "id", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias(name))

    x = scaled(vector, "v").join(scaled(keyword, "t"), ["qid", "id"], "full")
    score = F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("t", F.lit(0.0))
    return x.select("qid", "id", F.round(score, DIGITS).alias("score"))


def hybrid_search(vector: DataFrame, keyword: DataFrame, k: int = 10, least: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(qid, hit_rank, id, score): the best k of the fusion; only then those below ``least`` are dropped."""
    hits = top_k(fused(vector, keyword, alpha), "qid", "score", "id", k)
    return hits if least is None else hits.where(F.col("score") >= least)


class _Block:
    """A block of queries (qid, vector, k, and the column that must be equal) as arrays; a null vector scores no row."""

    def __init__(self, rows: list, same: str | None):
        self.qids = np.array([r["qid"] for r in rows], np.int64)
        self.k = np.array([r["k"] for r in rows], np.int64)
        self.has = np.array([r["vector"] is not None for r in rows])
        dim = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=0)
        v = np.array([r["vector"] if r["vector"] is not None else [0.0] * dim for r in rows], np.float64).reshape(len(rows), dim)
        size = np.linalg.norm(v, axis=1)
        self.vectors = v / np.where(size > 0, size, 1)[:, None]
        self.codes = {k: i for i, k in enumerate(dict.fromkeys(r[same] for r in rows if r[same] is not None))} if same else None
        self.kinds = np.array([self.codes.get(r[same], -2) for r in rows]) if same else None

    def cosine(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of a batch (id, vector, ...) that have a fitting vector, their score for each query, and which of them count."""
        dim = self.vectors.shape[1]
        fit = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False).to_numpy(zero_copy_only=False) & (dim > 0)
        rows = np.flatnonzero(fit)
        v = b.column(1).take(pa.array(rows, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        size = np.linalg.norm(v, axis=1)
        score = np.round(self.vectors @ (v / np.where(size > 0, size, 1)[:, None]).T, DIGITS) + 0.0
        may = np.repeat(self.has[:, None], len(rows), axis=1)
        if self.codes is not None:
            own = np.array([self.codes.get(x, -1) for x in b.column(2).take(pa.array(rows, pa.int64())).to_pylist()], np.int64)
            may &= self.kinds[:, None] == own[None, :]
        return rows, score, may


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, ROW_BLOCK) for at in range(0, b.num_rows, ROW_BLOCK))


class _Tile:
    """Up to TILE_QUERIES queries of one length of vectors and one kind, at ``at`` of their round: vectors, and who asks for each term."""

    def __init__(self, rows: list, at: int, vocabulary: dict[str, int]):
        self.at = slice(at, at + len(rows))
        v = np.array([r["vector"] or () for r in rows], np.float64).reshape(len(rows), -1)
        size = np.linalg.norm(v, axis=1)
        self.vectors = v / np.where(size > 0, size, 1)[:, None]
        pairs = sorted((vocabulary[t], q) for q, r in enumerate(rows) for t in r["t"])
        term, self.who = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.codes, self.first, self.many = np.unique(term, return_index=True, return_counts=True)


class _Round:
    """Queries (qid, vector, t, k, and the column that must be equal) that are asked at once, in tiles by kind; a null kind is left out."""

    def __init__(self, rows: list, same: str | None):
        groups: dict[tuple, list] = {}
        for r in rows:
            if r["k"] > 0 and (same is None or r[same] is not None):
                groups.setdefault((r[same] if same else 0, len(r["vector"] or ())), []).append(r)
        vocabulary: dict[str, int] = {}
        for r in rows:
            for t in r["t"]:
                vocabulary.setdefault(t, len(vocabulary))
        self.terms, self.idf, self.mean = pa.array(vocabulary, pa.string()), np.zeros(len(vocabulary)), 1.0
        self.same, self.kinds, self.tiles, order = same, list(dict.fromkeys(kind for kind, _ in groups)), {}, []
        for (kind, _), some in groups.items():
            for i in range(0, len(some), TILE_QUERIES):
                self.tiles.setdefault(kind, []).append(_Tile(some[i : i + TILE_QUERIES], len(order), vocabulary))
                order += some[i : i + TILE_QUERIES]
        self.qids, self.k = np.array([r["qid"] for r in order], np.int64), np.array([r["k"] for r in order], np.int64)

    def weigh(self, coded: DataFrame) -> None:
        """The weights of the terms, by what the corpus holds of them."""
        n, sizes = coded.agg(F.count("size"), F.sum("size")).first()
        if n:
            df = np.zeros(len(self.terms))
            for code, many in coded.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
                df[code] = many
            self.idf, self.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), sizes / n or 1.0

    def groups(self, b: pa.RecordBatch) -> Iterator[tuple[list[_Tile], _Rows]]:
        """The rows of a batch, up to ROW_BLOCK of one kind at a time, and the tiles that they count for."""
        if self.same is None:
            own = np.zeros(b.num_rows, np.int64)
        else:
            own = pc.fill_null(pc.index_in(b.column(self.same), value_set=pa.array(self.kinds).cast(b.column(self.same).type)), -1).to_numpy(zero_copy_only=False)
        for i, kind in enumerate(self.kinds):
            rows = np.flatnonzero(own == i)
            for at in range(0, len(rows), ROW_BLOCK):
                yield self.tiles[kind], _Rows(b.take(pa.array(rows[at : at + ROW_BLOCK])), self)


class _Rows:
    """Coded rows (id, vector, size, codes, counts) as arrays: unit vectors of a length, and the weight of each term asked for."""

    def __init__(self, b: pa.RecordBatch, asked: _Round):
        self.n, self.b, self.unit = b.num_rows, b, {}
        self.ids = pc.fill_null(b.column("id").cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(b.column("codes")).to_numpy(zero_copy_only=False))
        self.code, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "counts"))
        size = pc.fill_null(b.column("size"), 0).to_numpy(zero_copy_only=False)
        self.weight = asked.idf[self.code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.row] / asked.mean))

    def units(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have a vector of this length; their unit vectors, 0 for others."""
        if dim not in self.unit:
            v = self.b.column("vector")
            fit = pc.fill_null(pc.equal(pc.list_value_length(v), dim), False).to_numpy(zero_copy_only=False) & (dim > 0)
            out = np.zeros((self.n, dim))
            own = v.take(pa.array(np.flatnonzero(fit), pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else out[fit]
            size = np.linalg.norm(own, axis=1)
            own, size, fit[fit] = own[np.isfinite(size)], size[np.isfinite(size)], np.isfinite(size)
            out[fit] = own / np.where(size > 0, size, 1)[:, None]
            self.unit[dim] = fit, out
        return self.unit[dim]

    def said(self, tile: _Tile, place: np.ndarray) -> np.ndarray:
        """Queries x rows: keyword scores, not rounded. ``place`` has -1 for every term, before and after."""
        q = len(tile.vectors)
        place[tile.codes] = np.arange(len(tile.codes))
        local = place[self.code]
        place[tile.codes] = -1
        met = np.flatnonzero(local >= 0)
        local, row, weight = local[met], self.row[met], self.weight[met]
        first, many = tile.first[local], tile.many[local]
        out, upto, at = np.zeros(q * self.n), np.cumsum(many), 0
        while at < len(met):  # so many (query, row, term) at a time
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS_AT_ONCE, side="right")))
            n = many[at:to]
            who = tile.who[np.repeat(first[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            out += np.bincount(who * self.n + np.repeat(row[at:to], n), weights=np.repeat(weight[at:to], n), minlength=len(out))
            at = to
        return out.reshape(q, self.n)


#: A keyword score beyond this one isn't 0 when rounded.
_SEEN = 0.5 * 10.0**-DIGITS
#: Stands for a null id, which comes first among equals.
_NO_ID = -(1 << 63)


def _coded_batches(shared, kept: list[str]):
    """Rows (..., t) to rows with the number of their terms (size) and, of the terms asked for, the codes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        wide = max(1, len(words))
        for b in batches:
            t = b.column("t")
            size = pc.list_value_length(t)
            code = pc.fill_null(pc.index_in(t.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
            spot, tf = np.unique(row[code >= 0] * wide + code[code >= 0], return_counts=True)
            row, code = np.divmod(spot, wide)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], size, *lists], names=[*kept, "size", "codes", "counts"])

    return run


def _span_batches(shared):
    """The least and greatest score of every query within a partition, by vector and by keyword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Round = shared.value
        place = np.full(len(asked.terms), -1, np.int64)
        vlo, vhi, tlo, thi = (np.full(len(asked.qids), x) for x in (np.inf, -np.inf) * 2)
        for b in batches:
            for tiles, rows in asked.groups(b):
                for tile in tiles:
                    fit, unit = rows.units(tile.vectors.shape[1])
                    if fit.any():
                        cosine = tile.vectors @ (unit if fit.all() else unit[fit]).T
                        vlo[tile.at], vhi[tile.at] = np.minimum(vlo[tile.at], cosine.min(axis=1)), np.maximum(vhi[tile.at], cosine.max(axis=1))
                    said = rows.said(tile, place)
                    thi[tile.at] = np.maximum(thi[tile.at], said.max(axis=1))
                    tlo[tile.at] = np.minimum(tlo[tile.at], np.where(said > _SEEN, said, np.inf).min(axis=1))
        thi[thi <= _SEEN] = -np.inf
        ends = [pa.array(np.where(np.isfinite(x), np.round(x, DIGITS) + 0.0, np.nan), from_pandas=True) for x in (vlo, vhi, tlo, thi)]
        yield pa.RecordBatch.from_arrays([pa.array(asked.qids), *ends], names=["qid", "vlo", "vhi", "tlo", "thi"])

    return run


class _Side:
    """The scores of a side, scaled to 0..share within a query: score * by + off; share where all of a side are equal."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, share: float):
        self.wide, self.share, self.lo = hi > lo, share, np.where(hi > lo, lo, 0.0)
        self.width = np.where(self.wide, hi - lo, 1.0)
        self.by = np.where(self.wide, share / self.width, 0.0)
        self.off = np.where(self.wide, -self.lo * self.by, share)

    def exact(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.share * np.where(self.wide[q], (np.round(score, DIGITS) + 0.0 - self.lo[q]) / self.width[q], 1.0)


class _Best:
    """The best k of each query so far, and a score (least) that each of its k best reaches."""

    def __init__(self, k: np.ndarray):
        self.k, self.least, self.held, self.new = k, np.full(len(k), -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, ids, score))
        self.new += len(q)
        if self.new > max(MEETINGS_AT_ONCE, len(self.held[0][0])) // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k[q] - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        kept = rank < self.k[q]
        self.held, self.new = [(q[kept], ids[kept], score[kept])], 0
        return self.held[0]


def _fused_batches(shared, spans, alpha: float):
    """The k best of every query by fused score within a partition.

    All pairs get their score without rounding, off the exact one by ``slack`` at most; those that can be among the best get the exact one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Round = shared.value
        vlo, vhi, tlo, thi = spans.value
        v, t, best = _Side(vlo, vhi, alpha), _Side(tlo, thi, 1 - alpha), _Best(asked.k)
        slack = (np.abs(v.by) + np.abs(t.by) + 1) * 0.6 * 10.0**-DIGITS
        place = np.full(len(asked.terms), -1, np.int64)
        for b in batches:
            for tiles, rows in asked.groups(b):
                for tile in tiles:
                    at, n = tile.at, rows.n
                    fit, unit = rows.units(tile.vectors.shape[1])
                    score = (tile.vectors * v.by[at, None]) @ unit.T
                    score += v.off[at, None]
                    said = rows.said(tile, place).ravel()
                    spoken = np.flatnonzero(said > _SEEN)
                    q = spoken // n + at.start
                    more = said[spoken] * t.by[q] + t.off[q]
                    if fit.all():
                        score.ravel()[spoken] += more
                    else:
                        had = np.where(fit[spoken % n], score.ravel()[spoken], 0.0)
                        score[:, ~fit] = -np.inf
                        score.ravel()[spoken] = had + more
                    for i in np.flatnonzero(np.isneginf(best.least[at]) & (asked.k[at] <= n)):
                        k = asked.k[at][i]
                        best.least[at.start + i] = np.partition(score[i], n - k)[n - k] - slack[at.start + i]
                    found = np.flatnonzero((score >= (best.least[at] - slack[at])[:, None]) & np.isfinite(score))
                    for f in (found[x : x + ROW_BLOCK * 8] for x in range(0, len(found), ROW_BLOCK * 8)):
                        i, r = np.divmod(f, n)
                        q = i + at.start
                        cosine = np.einsum("ij,ij->i", tile.vectors[i], unit[r])
                        exact = np.where(said[f] > _SEEN, t.exact(said[f], q), 0.0) + np.where(fit[r], v.exact(cosine, q), 0.0)
                        best.add(q, rows.ids[r], np.round(exact, DIGITS) + 0.0)
        q, ids, score = best.settle()
        for x in range(0, len(q), MEETINGS_AT_ONCE):
            some = slice(x, x + MEETINGS_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked.qids[q[some]]), pa.array(ids[some], mask=ids[some] == _NO_ID), pa.array(score[some]), pa.array(asked.k[q[some]].astype(np.int32))], names=["qid", "id", "score", "k"]
            )

    return run


def _rounds(queries: DataFrame) -> Iterator[list]:
    """The queries, a stated set, ASKED_AT_ONCE or as many as hold VALUES_AT_ONCE terms and numbers at a time."""
    some, held = [], 0
    for r in queries.toLocalIterator():
        own = len(r["t"]) + len(r["vector"] or ())
        if some and (len(some) == ASKED_AT_ONCE or held + own > VALUES_AT_ONCE):
            yield some
            some, held = [], 0
        some.append(r)
        held += own
    if some:
        yield some


def hybrid_full(queries: DataFrame, corpus: DataFrame, k: int | str = 10, least: float | None = None, alpha: float = ALPHA, same: str | None = None) -> DataFrame:
    """(qid, hit_rank, id, score): the best k of the fusion over all scores of both sides; only then those below ``least`` are dropped.

    As ``hybrid_search`` of the vector and keyword scores of all rows, without a table of them. The corpus (id, vector, text) is
    read and cut into terms once for all queries of a round, up to ASKED_AT_ONCE, and kept with the terms asked for; over that a first pass finds each
    query's least and greatest scores, a second one scores every row where it is and sends on each partition's own k best. ``k`` may
    name a column of the queries (qid, text, vector); a null one gives no hit. A row without
    a vector or a text counts by the other side only (a null text isn't a document of the keyword side, an empty one is), and
    so do all rows for a query without one. ``same`` names a column
    that must be equal; a query meets only the rows of its own.
    """
    part, row, spark = [same] if same else [], "qid long, id long, score double, k int", corpus.sparkSession
    kept = ["id", "vector", *part]
    t = F.when(F.col("text").isNotNull(), terms(F.col("text"))).alias("t")
    cut = spread(corpus.select(*kept, "text")).select(*kept, t)
    schema = T.StructType([*cut.drop("t").schema.fields, *[T.StructField(c, x) for c, x in (("size", T.IntegerType()), ("codes", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.IntegerType())))]])
    limit = (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int")
    asked = written(queries.select("qid", "vector", *part, F.array_distinct(terms(F.col("text"))).alias("t"), limit.alias("k")).where("k IS NOT NULL"), "asked")
    out = []
    for some in _rounds(asked):
        these = _Round(some, same)
        if len(these.qids) == 0:
            continue
        coded = written(cut.mapInArrow(_coded_batches(spark.sparkContext.broadcast(these.terms), kept), schema), "coded")
        these.weigh(coded)
        shared = spark.sparkContext.broadcast(these)
        ends = coded.mapInArrow(_span_batches(shared), "qid long, vlo double, vhi double, tlo double, thi double")
        ends = ends.groupBy("qid").agg(*[(F.max if c.endswith("hi") else F.min)(c).alias(c) for c in ("vlo", "vhi", "tlo", "thi")])
        found = {r["qid"]: [np.nan if x is None else x for x in r[1:]] for r in ends.collect()}  # one row per query
        spans = spark.sparkContext.broadcast(np.array([found.get(q, [np.nan] * 4) for q in these.qids.tolist()]).T)
        out.append(coded.mapInArrow(_fused_batches(shared, spans, alpha), row))
    scored = reduce(DataFrame.union, out) if out else spark.createDataFrame([], row)
    hits = top_k(scored, "qid", "score", "id", "k").select("qid", "hit_rank", "id", "score")
    return hits if least is None else hits.where(F.col("score") >= least)


def valid_questions(questions: DataFrame, bases: DataFrame) -> DataFrame:
    """(qid, question, kb_id, k, threshold, outcome): one row per qid; why a question can't be asked, or ``ok``."""
    one = questions.groupBy("qid").agg(*[F.min(c).alias(c) for c in ("question", "kb_id", "k", "threshold")])
    known = bases.select("kb_id", F.lit(True).alias("known")).distinct()
    x = one.join(known, "kb_id", "left")
    outcome = F.when(~shown(F.col("question")), "invalid question").when(F.col("known").isNull(), "nothing found").otherwise("ok")
    return x.select("qid", "question", "kb_id", "k", "threshold", outcome.alias("outcome"))


def formatted(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, hit_rank, chunk_id, chunk_type, content, similarity_score, metadata) with metadata as JSON of the fields present."""
    fields = ["doc_id", "description", "keywords", "parent_id", "sheet", "table_id", "row_no", "header", "paragraph_index"]
    meta = chunks.select("chunk_id", F.to_json(F.struct(*fields)).alias("metadata"))
    cols = ["qid", "hit_rank", "chunk_id", "chunk_type", "content", F.coalesce("score", F.lit(0.0)).alias("similarity_score"), "metadata"]
    return hits.join(meta, "chunk_id", "left").select(*cols)
