"""Set-similarity join over inverted lists that are skipped by position.

A set's runs are put in one global order, rare ones first. Sets of likeness t share a run among the first n - ceil(t n) + 1,
so only these prefixes are listed. The lists of a range of runs come together in one task; a run that very many sets hold
is split further, into tasks for pairs of blocks of its sets. A list is sorted by set size; from an entry's position
follows the largest size that a partner may have, so the rest of the list is skipped as a block, and a partner too far
back in its own set is skipped too. Entries carry a sketch of 256 bits, which drops most other pairs and is cut so low that a
link at the threshold gets lost once in ``1 / LOSS``; an exact bound by longer sketches and an exact check follow, on the
few pairs left.

What a set sends grows with its listed runs only: entries travel in blocks, a sketch of 32 bytes for each range that the set
has runs in, however many ranges there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shingles import RUN, bare, minhashes, runs, sketches
from docloom.runtime import written

#: Buckets of the run counts that fix the global order, and counts per row when they are added up. Bounded, whatever the data.
BUCKETS, PIECE = 1 << 20, 1 << 12
#: Rows of counts that one task adds up.
FAN = 512
#: Listed runs per range, sets of a run that is split, pairs looked at together, sets taken together.
RANGE_RUNS, HOT_SETS, PAIRS_AT_ONCE, SETS_AT_ONCE = 1_500_000, 200_000, 1 << 18, 1000
#: Standard deviations below the expected agreement at which a sketch drops a pair, and the chance of that at the threshold.
SIGMAS, LOSS = 5.0, 3e-7
#: Bits of the parity sketch, by set size: over BITS[i][0] runs the next row holds. With over twice the bits of its runs a
#: sketch tells sets of a likeness of 0.3 from those of 0.6.
BITS = ((230, 512), (460, 1024), (930, 2048), (1 << 62, 4096))
_EPS = 1e-9
#: A bare text with its sketches, or (piece, part, counts): how many of a task's sets hold a run of each bucket.
ROWS = "id long, text_hash long, text string, size int, sketch binary, parity binary, piece int, part int, counts binary"


def parity(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity sketch of each set, as long as its size asks for."""
    widest = BITS[-1][1]
    bit = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64)  # 12 bits
    odd = (np.bincount(owner * widest + bit, minlength=len(sizes) * widest) & 1).astype(np.uint8).reshape(len(sizes), widest)
    out: list[bytes] = [b""] * len(sizes)
    for most, bits in reversed(BITS):
        mine = np.flatnonzero(sizes <= most)
        folded = np.bitwise_xor.reduce(odd[mine].reshape(len(mine), widest // bits, bits), axis=1)
        for i, row in zip(mine, np.packbits(folded, axis=1)):
            out[i] = row.tobytes()
    return out


def sketched_batches(parts: int):
    """mapInArrow function: (id, mapped text) to ROWS; texts shorter than a run are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        names = [c.split()[0] for c in ROWS.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, SETS_AT_ONCE):
                b = whole.slice(at, SETS_AT_ONCE)
                texts = [bare(t) for t in b.column(1).to_pylist()]
                keep = [i for i, t in enumerate(texts) if len(t) >= RUN]
                texts = [texts[i] for i in keep]
                h, off = runs(texts)
                sizes = np.diff(off)
                total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                short = sketches(minhashes(h, off)).view(np.uint8).reshape(len(texts), 32) if texts else np.zeros((0, 32), np.uint8)
                hashes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
                cols = [
                    b.column(0).take(pa.array(keep, pa.int64())), pa.array(hashes, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes.astype(np.int32)),
                    pa.array([x.tobytes() for x in short], pa.binary()), pa.array(parity(h, np.repeat(np.arange(len(texts)), sizes), sizes) if texts else [], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(texts), k) for k in kinds[6:]]], names=names)
        pieces = total.reshape(-1, PIECE)
        live = np.flatnonzero(pieces.any(axis=1))
        part = TaskContext.get().partitionId() % parts if TaskContext.get() else 0
        rows = [pa.array(live.astype(np.int32)), pa.array(np.full(len(live), part, np.int32)), pa.array([pieces[k].tobytes() for k in live], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(live), k) for k in kinds[:6]], *rows], names=names)

    return run


def sketched(rows: DataFrame) -> DataFrame:
    """(id, mapped text) as a written table of ROWS: every text is hashed once for its sketches and for the counts."""
    return written(rows.mapInArrow(sketched_batches(max(1, math.ceil(rows.rdd.getNumPartitions() / FAN))), ROWS), "sketched")


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.int64)
    for b in group.column("counts").to_pylist():
        total += np.frombuffer(b, np.int64)
    first = group.slice(0, 1)
    return pa.table({"piece": first.column("piece"), "part": first.column("part"), "counts": pa.array([total.tobytes()], pa.binary())})


def bucket_counts(table: DataFrame) -> np.ndarray:
    """The counts over all texts; added up in the cluster, FAN rows at a time, and of a fixed size on the driver."""
    added, schema = table.where("piece IS NOT NULL").select("piece", "part", "counts"), "piece int, part int, counts binary"
    added = added.groupBy("piece", "part").applyInArrow(_add, schema)
    tops = added.agg(F.max("part")).first()[0]
    if tops:  # more parts than one
        added = added.groupBy("piece").applyInArrow(_add, schema)
    out = np.zeros((BUCKETS // PIECE, PIECE), np.int64)
    for r in added.collect():
        out[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


class Plan:
    """The global order of the buckets and the tasks that their lists go to. Of a fixed size, whatever the data."""

    def __init__(self, counts: np.ndarray, least: float):
        self.rank = np.empty(BUCKETS, np.uint32)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
        self.ranges = max(1, math.ceil((1 - least + 0.02) * int(counts.sum()) / RANGE_RUNS))
        # the sets of a hot bucket are dealt to blocks, and every pair of blocks is a task of its own
        self.blocks = np.maximum(1, np.ceil(counts / HOT_SETS)).astype(np.int64)
        cells = np.where(self.blocks > 1, self.blocks * self.blocks, 0)
        self.base = self.ranges + np.cumsum(cells) - cells

    def tasks(self, bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, task, side) of listed runs: side 2 where all pairs of a task count, 0 and 1 where only those between sides do."""
        entry, task, side = [np.arange(len(bucket))], [(self.rank[bucket] % self.ranges).astype(np.int64)], [np.full(len(bucket), 2, np.uint8)]
        n = self.blocks[bucket]
        hot = np.flatnonzero(n > 1)
        if len(hot):
            plain = np.flatnonzero(n == 1)
            entry, task, side = [plain], [task[0][plain]], [side[0][plain]]
            own = (ids[hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n[hot]
            for k in range(int(n[hot].max())):
                to = hot[n[hot] > k]
                mine = own[n[hot] > k]
                lo, hi = np.minimum(mine, k), np.maximum(mine, k)
                entry.append(to), task.append(self.base[bucket[to]] + lo * n[to] + hi)
                side.append(np.where(mine == k, 2, (mine > k).astype(np.int64)).astype(np.uint8))
        return np.concatenate(entry), np.concatenate(task), np.concatenate(side)


LISTS = "task long, ids binary, sizes binary, sides binary, sketches binary, per binary, runs binary, places binary"


def _prefix_batches(plan, least: float):
    """(id, text, sketch) to LISTS: a row for each task that a block of sets has listed runs for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        names = [c.split()[0] for c in LISTS.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, SETS_AT_ONCE):
                b = whole.slice(at, SETS_AT_ONCE)
                ids = b.column(0).to_numpy()
                short = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(ids), 4)
                h, off = runs(b.column(1).to_pylist())
                sizes = np.diff(off)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
                key = (p.rank[bucket].astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
                order = np.lexsort((key, owner))
                place = np.arange(len(h)) - np.repeat(off[:-1], sizes)
                listed = place < np.repeat(sizes - np.ceil(least * sizes - _EPS).astype(np.int64) + 1, sizes)
                code = (h[order][listed] >> np.uint64(32)).astype(np.uint32)
                bucket, place, owner = bucket[order][listed], place[listed], owner[listed]
                entry, task, side = p.tasks(bucket, ids[owner])
                by = np.lexsort((owner[entry], task))
                entry, task, side = entry[by], task[by], side[by]
                code, place, owner = code[entry], place[entry], owner[entry]
                new = np.ones(len(task), bool)
                new[1:] = (task[1:] != task[:-1]) | (owner[1:] != owner[:-1]) | (side[1:] != side[:-1])
                starts = np.flatnonzero(new)
                sets, per = owner[starts], np.diff(np.append(starts, len(task)))
                firsts = np.flatnonzero(np.concatenate([[True], task[starts][1:] != task[starts][:-1]])) if len(starts) else np.zeros(0, np.int64)
                ends, deep = np.append(firsts, len(starts)), np.append(starts[firsts], len(task))
                near = np.minimum(place, 65535).astype(np.uint16)  # a place further back counts as this one: fewer are skipped, none is lost

                def packed(a: np.ndarray, ends: np.ndarray) -> pa.Array:
                    offsets = pa.py_buffer((ends * (a.nbytes // max(1, len(a)))).astype(np.int64))
                    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())

                cols = [packed(a, ends) for a in (ids[sets], sizes[sets].astype(np.int32), side[starts], short[sets], per.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(task[starts[firsts]], pa.int64()), *cols, packed(code, deep), packed(near, deep)], names=names)

    return run


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All values of a binary column one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _join_task(least: float):
    share = least / (1 + least)
    p = (1 + least) / 2
    allowed = [bits - math.floor(bits * p - SIGMAS * math.sqrt(bits * p * (1 - p))) for bits in (128, 256)]

    def run(group: pa.Table) -> pa.Table:
        ids, size, side = _flat(group.column("ids"), np.int64), _flat(group.column("sizes"), np.int32).astype(np.int64), _flat(group.column("sides"), np.uint8)
        short = _flat(group.column("sketches"), np.uint64).reshape(len(ids), 4)
        halves = [np.ascontiguousarray(short[:, :2]), np.ascontiguousarray(short[:, 2:])]
        code, place = _flat(group.column("runs"), np.uint32), _flat(group.column("places"), np.uint16)
        rec = np.repeat(np.arange(len(ids)), _flat(group.column("per"), np.uint32))
        split = bool((side != 2).any())
        key = (code.astype(np.int64) << 31) | size[rec]
        by = np.argsort(key, kind="stable")
        key, rec, place = key[by], rec[by], place[by].astype(np.int64)
        n = size[rec]
        left = n - place  # runs from here on, this one included
        # the largest partner: by size alone, and so that the runs left can still reach the overlap
        most = np.floor(np.minimum(n / least, left / share - n) + _EPS).astype(np.int64)
        here = np.arange(len(key))
        last = np.searchsorted(key, (key & ~np.int64((1 << 31) - 1)) | np.clip(most, 0, (1 << 31) - 1), side="right")
        count = np.maximum(last - here - 1, 0)
        first = np.flatnonzero(count)
        upto = np.cumsum(count[first])
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(first):
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, side="right")))
            mine = first[at:to]
            a = np.repeat(mine, count[mine])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
            ok = left[b] >= np.ceil(share * (n[a] + n[b]) - _EPS)
            a, b = rec[a[ok]], rec[b[ok]]
            if split:
                ok = (side[a] == 2) | (side[a] != side[b])
                a, b = a[ok], b[ok]
            x = np.bitwise_count(halves[0][a] ^ halves[0][b]).sum(axis=1, dtype=np.int64)
            ok = np.flatnonzero((x <= allowed[0]) & (a != b))
            a, b, x = a[ok], b[ok], x[ok]
            x += np.bitwise_count(halves[1][a] ^ halves[1][b]).sum(axis=1, dtype=np.int64)
            ok = x <= allowed[1]
            found.append(np.unique(np.minimum(a[ok], b[ok]) * len(ids) + np.maximum(a[ok], b[ok])))
            at = to
        pairs = np.unique(np.concatenate(found))
        x, y = ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))]
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())}).filter(pa.array(x != y))

    return run


def folded(sketch: bytes, width: int) -> np.ndarray:
    """A parity sketch at the width of a shorter one."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, width // 8), axis=0)


def _bound_batches(least: float):
    """(a, b, size_a, parity_a, size_b, parity_b) to the (a, b) whose parity sketches still allow the likeness; an exact bound."""
    share, widths = least / (1 + least), [bits // 8 for _, bits in BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("size_a").to_numpy().astype(np.int64) + b.column("size_b").to_numpy()
            room = n - 2 * np.ceil(share * n - _EPS).astype(np.int64)
            pa_, pb_ = b.column("parity_a").to_pylist(), b.column("parity_b").to_pylist()
            common = np.array([min(len(x), len(y)) for x, y in zip(pa_, pb_)], np.int64)
            keep = np.zeros(b.num_rows, bool)
            for w in widths:
                s = np.flatnonzero(common == w)
                if len(s):
                    u, v = (np.array([folded(side[i], w) for i in s]) for side in (pa_, pb_))
                    keep[s] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64) <= room[s]
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])

    return run


def links_of(table: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of leaders that may reach the likeness, few others.

    ``table`` is a ``sketched`` one, ``leaders`` its rows (id, text, sketch, size, parity) of which each stands for one text.
    """
    shared = table.sparkSession.sparkContext.broadcast(Plan(bucket_counts(table), least))  # BUCKETS x 20 bytes
    lists = leaders.select("id", "text", "sketch").mapInArrow(_prefix_batches(shared, least), LISTS)
    pairs = lists.groupBy("task").applyInArrow(_join_task(least), "a long, b long").distinct()
    for end in ("a", "b"):
        known = leaders.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("parity").alias(f"parity_{end}"))
        pairs = pairs.join(known, end)
    return pairs.mapInArrow(_bound_batches(least), "a long, b long")


def candidate_links(texts: DataFrame, least: float) -> DataFrame:
    """``links_of`` texts (id, text) of which each is its own leader; one without a run has no link."""
    table = sketched(texts)
    return links_of(table, table.where("piece IS NULL"), least)
