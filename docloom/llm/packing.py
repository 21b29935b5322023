"""Problem 6: filling containers of fixed capacity with items, by bounded-space online best fit.

Items are dealt to shards of bounded size by the hash of a row number, so that a repeated key is spread too. In a shard a fixed number of bins is open per capacity, kept in a
bitset keyed by free space: an item goes to the open bin with the least sufficient space; when none fits and all places
are taken, the fullest closes. The bins that a shard leaves open become items of the next round, in which few shards
hold the leftovers of many, until one shard is left; so the space lost is that of a fixed number of bins in all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import written

OPEN_BINS, SHARD_ITEMS = 256, 40_000


class BestFit:
    """One stream of sizes into bins of one capacity."""

    def __init__(self, capacity: int, places: int = OPEN_BINS):
        self.capacity, self.places = capacity, places
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def put(self, size: int) -> int:
        """The bin that the item goes to; size is at most the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.places:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        if free > size:
            self.by_free.setdefault(free - size, []).append(b)
            self.bits |= 1 << (free - size)
            self.open += 1
        return b

    def still_open(self) -> set[int]:
        return {b for bins in self.by_free.values() for b in bins}


def _pack_shard(capacities: list[tuple[int, int]], level: int):
    """(shard, item, size) rows of one shard to (cap_id, item, part, start, size, bin, open)."""

    def run(batch: pa.Table) -> pa.Table:
        shard = batch.column("shard")[0].as_py() if batch.num_rows else 0
        items, sizes = batch.column("item").to_numpy(), batch.column("size").to_numpy()
        order = np.lexsort((sizes, items))
        caps = batch.column("cap_id").to_numpy() if level else None
        out: list[list] = [[] for _ in range(7)]
        for cap_id, capacity in capacities:
            fit, rows = BestFit(capacity), []
            for i in order if caps is None else order[caps[order] == cap_id]:
                item, size, at, part = int(items[i]), int(sizes[i]), 0, 1
                while size - at > capacity:  # only what alone exceeds the capacity is divided
                    rows.append((cap_id, item, part, at, capacity, fit.put(capacity)))
                    at, part = at + capacity, part + 1
                if size - at:
                    rows.append((cap_id, item, part, at, size - at, fit.put(size - at)))
            left = fit.still_open()
            for r in rows:
                for c, v in zip(out, (*r[:5], (level << 58) | (shard << 26) | r[5], r[5] in left)):
                    c.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["cap_id", "item", "part", "start", "size", "bin", "open"])

    return run


_ROWS = "cap_id int, item long, part int, start long, size long, bin long, open boolean"


def pack(items: DataFrame, capacities: list[tuple[int, int]], key: str, size: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(cap_id, container_id, <key>, part_no, start_token, n_tokens): every item in a container of every capacity.

    ``capacities`` is a short list of (cap_id, capacity). Items without tokens take no space and come out with a null
    container. Items of one key are packed each. A capacity below 1 is an error.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be at least 1")
    items = items.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    items = written(items.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "sized")
    some = items.where("size > 0")
    shards = max(1, math.ceil(some.count() / shard_items))
    placed = written(
        some.withColumn("shard", F.pmod(F.col("salt"), F.lit(shards)).cast("int")).drop("salt")
        .groupBy("shard").applyInArrow(_pack_shard(capacities, 0), _ROWS), "placed"
    )
    moved = placed.where("open").groupBy("cap_id", "bin").agg(F.sum("size").alias("size"))
    names = written(moved.select("cap_id", "bin", F.col("bin").alias("now"), "size"), "open-bins")
    level = 1
    per = max(2, shard_items // (OPEN_BINS * max(1, len(capacities))))
    while True:
        shards = math.ceil(shards / per)
        bins = names.groupBy("cap_id", "now").agg(F.sum("size").alias("size"))
        again = bins.select((F.pmod(F.xxhash64("now"), F.lit(shards)).cast("int")).alias("shard"), F.col("now").alias("item"), "size", "cap_id")
        again = again.groupBy("shard").applyInArrow(_pack_shard(capacities, level), _ROWS).select("cap_id", F.col("item").alias("now"), F.col("bin").alias("next"))
        names = written(names.join(again, ["cap_id", "now"]).select("cap_id", "bin", F.col("next").alias("now"), "size"), "open-bins")
        level += 1
        if shards <= 1:
            break
    out = placed.join(names.select("cap_id", "bin", "now"), ["cap_id", "bin"], "left").select(
        "cap_id", F.coalesce("now", "bin").alias("container_id"), F.col("item").alias(key), F.col("part").alias("part_no"),
        F.col("start").alias("start_token"), F.col("size").alias("n_tokens"),
    )
    none = items.where("size = 0")
    for i, (cap_id, _) in enumerate(capacities):
        row = none.select(
            F.lit(cap_id).cast("int").alias("cap_id"), F.lit(None).cast("long").alias("container_id"), F.col("item").alias(key),
            F.lit(1).alias("part_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"),
        )
        out = out.unionByName(row)
    return out


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(cap_id, capacity_tokens, containers, least_containers, tokens, fill_share) of a packing."""
    bins = packed.where("container_id IS NOT NULL").groupBy("cap_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = bins.groupBy("cap_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    c = F.col("capacity_tokens")
    return total.join(capacities.select("cap_id", "capacity_tokens"), "cap_id").select(
        "cap_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / c).alias("least_containers"), "tokens",
        F.round(F.col("tokens") / (F.col("containers") * c), 6).alias("fill_share"),
    )
