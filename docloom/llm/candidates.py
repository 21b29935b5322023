"""Shared steps of the near-duplicate operators: candidate lists, checked joins and exact verification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shingles import PAIRS, likeness_batches
from docloom.runtime import written

#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Standard deviations below the expected agreement at which a sketch drops a pair, and the chance of that at the threshold.
SIGMAS, SKETCH_LOSS = 4, 3.2e-5


def checked(ids: DataFrame) -> DataFrame:
    """``ids`` (a small written table) with a broadcast hint only if its row count is within the bound."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def agreeing(bits: int, least: float, words: int) -> int:
    """Bits that the sketches of sets of likeness ``least`` agree in, less four standard deviations."""
    p = (1 + least) / 2
    return math.floor(bits * p - SIGMAS * math.sqrt(bits * p * (1 - p))) if words else 0


def sketch_filter(words: list[str], least: float) -> Column:
    n = 64 * len(words)
    differing = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))
    return differing <= n - agreeing(n, least, len(words))


def size_filter(least: float) -> Column:
    a, b = F.col("a.size"), F.col("b.size")
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least)


def candidate_pairs(left: DataFrame, right: DataFrame, least: float, same: bool) -> DataFrame:
    """Distinct (a, b) that share a list: left and right are postings (key, id, size, s0, s1)."""
    order = F.col("a.id") < F.col("b.id") if same else F.col("a.id") != F.col("b.id")
    on = (F.col("a.key") == F.col("b.key")) & order & size_filter(least) & sketch_filter(["s0", "s1"], least)
    return left.alias("a").join(right.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def likely_pairs(pairs: DataFrame, sigs_a: DataFrame, sigs_b: DataFrame, least: float) -> DataFrame:
    """The candidate pairs whose whole sketches still allow the likeness."""
    words = ["s0", "s1", "s2", "s3"]
    cols = [F.struct(*words)]
    x = pairs.join(sigs_a.select(F.col("id").alias("a"), cols[0].alias("ska")), "a").join(sigs_b.select(F.col("id").alias("b"), cols[0].alias("skb")), "b")
    differing = sum((F.bit_count(F.col(f"ska.{w}").bitwiseXOR(F.col(f"skb.{w}"))) for w in words), F.lit(0))
    return x.where(differing <= 256 - agreeing(256, least, 4)).select("a", "b")


def verified(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose exact likeness is at least ``least``; texts: (id, text).

    Few pairs are broadcast to the texts of their first ends, so that only those texts move; many are joined by shuffle.
    """
    pairs = checked(written(pairs, "likely"))
    ta, tb = texts_a.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts_b.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return ta.join(pairs, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(likeness_batches(least), PAIRS)
