"""Character-run sets of texts and their MinHash signatures, in Arrow batches.

The likeness of two texts is that of their sets of distinct runs of five characters, after the look-alike form and
without blanks and line breaks. A run is known by a 64-bit hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

RUN = 5
HASHES = 256
_BLOCK = 1 << 15  # runs handled at a time, so that the arrays stay in the CPU's cache
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bare(mapped: str | None) -> str:
    """A look-alike-mapped text, composed and without blanks and line breaks."""
    return "".join(unicodedata.normalize("NFC", mapped or "").split())


def runs(texts: list[str], n: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct run hashes of each text, one text after the other."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h *= _M1
        h += codes[k : len(codes) - n + 1 + k]
    h ^= h >> np.uint64(30)
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    owner = np.repeat(np.arange(len(texts)), lens)
    inside = owner[: len(h)] == owner[n - 1 :]
    h, owner = h[inside], owner[: len(inside)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


_MULT = (np.random.default_rng(20240501).integers(1, 1 << 32, 4 * HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def minhashes(h: np.ndarray, offsets: np.ndarray, count: int = HASHES) -> np.ndarray:
    """count x texts minima of as many hash functions; texts without runs get 0xFFFFFFFF."""
    texts = len(offsets) - 1
    out = np.full((count, texts), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < texts:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK, side="right")) - 1)
        filled = np.flatnonzero(np.diff(offsets[at : to + 1])) + at
        if len(filled):
            part = h[offsets[at] : offsets[to]]
            lo, hi = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            starts = offsets[filled] - offsets[at]
            for j in range(count):
                out[j, filled] = np.minimum.reduceat(lo * _MULT[j] + hi, starts)
        at = to
    return out


def packed_keys(mins: np.ndarray, groups: int, per: int, bits: int) -> np.ndarray:
    """texts x groups: the low ``bits`` of ``per`` minima side by side, the first of a group highest."""
    mask = np.uint64((1 << bits) - 1)
    keys = np.zeros((mins.shape[1], groups), np.uint64)
    for g in range(groups):
        for j in range(per):
            keys[:, g] = (keys[:, g] << np.uint64(bits)) | (mins[(g * per + j) % len(mins)].astype(np.uint64) & mask)
    return keys


def sketches(mins: np.ndarray) -> np.ndarray:
    """texts x 4 words: one bit of each of 256 minima. Two sets of likeness J agree in a share (1 + J) / 2 of the bits."""
    bits = ((mins[:256] >> np.uint32(20)) & np.uint32(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of each pair of bare texts; 0 where one has no run."""
    texts = list(dict.fromkeys([*a, *b]))
    place = {t: i for i, t in enumerate(texts)}
    h, off = runs(texts)
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        p, q = place[x], place[y]
        u, v = h[off[p] : off[p + 1]], h[off[q] : off[q + 1]]
        if len(u) and len(v):
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            out[i] = both / (len(u) + len(v) - both)
    return out


def signature_batches(groups: int, per: int, bits: int, id_type: pa.DataType = pa.int64(), with_text: bool = False):
    """mapInArrow function: (id, mapped text) to (id, text_hash, size, s0..s3, keys[, text]); texts without a run are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = b.column(0)
                texts = [bare(t) for t in b.column(1).to_pylist()]
                h, off = runs(texts)
                size = np.diff(off)
                keep = np.flatnonzero(size)
                mins = minhashes(h, off, max(256, groups * per))[:, keep]
                keys, sk = packed_keys(mins, groups, per, bits).view(np.int64), sketches(mins)
                hashes = np.array([xxhash.xxh3_64_intdigest(texts[i]) for i in keep], np.uint64).view(np.int64)
                cols = [ids.take(pa.array(keep)), pa.array(hashes, pa.int64()), pa.array(size[keep].astype(np.int32))]
                cols += [pa.array(np.ascontiguousarray(sk[:, k])) for k in range(4)]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, groups, dtype=np.int32)), pa.array(keys.ravel())))
                names = ["id", "text_hash", "size", "s0", "s1", "s2", "s3", "keys"]
                if with_text:
                    cols.append(pa.array([texts[i] for i in keep], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


SIGNATURE = "id long, text_hash long, size int, s0 long, s1 long, s2 long, s3 long, keys array<long>"


def likeness_batches(least: float):
    """mapInArrow function: (a, b, text_a, text_b) to the (a, b, likeness) of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ta, tb = ([bare(t) for t in b.column(i).to_pylist()] for i in (2, 3))
                j = likeness(ta, tb)
                keep = pa.array(np.flatnonzero(j >= least - 1e-12))
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(j).take(keep)], names=["a", "b", "likeness"])

    return run


PAIRS = "a long, b long, likeness double"
