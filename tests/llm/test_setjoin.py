from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import setjoin, shingles
from tests_llm_texts import edited, likeness, text


def test_parity_sketch_bounds_the_difference():
    rng = random.Random(5)
    texts = []
    for n in (100, 390, 420, 800, 900, 3000):
        base = text(rng, n)
        texts += [base, edited(rng, base, 0.05), edited(rng, base, 0.3)]
    h, off = shingles.runs(texts)
    sizes = np.diff(off)
    raw = setjoin.parity(h, np.repeat(np.arange(len(texts)), sizes), sizes)
    sets = [set(h[off[i] : off[i + 1]].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            w = min(len(raw[i]), len(raw[j]))
            assert np.bitwise_count(setjoin.folded(raw[i], w) ^ setjoin.folded(raw[j], w)).sum() <= len(sets[i] ^ sets[j])
    assert {len(x) * 8 for x in raw} == {512, 1024, 2048, 4096}


@pytest.mark.parametrize(("least", "ranges", "hot"), [(0.6, 400, 10**6), (0.8, 10**6, 10**6), (0.5, 3000, 10**6), (0.6, 400, 7), (0.5, 10**6, 3)])
def test_no_link_is_lost(spark, monkeypatch, least, ranges, hot):
    """Against brute force, over set sizes of all sketch levels, with few and many ranges, with hot runs split and unsplit."""
    monkeypatch.setattr(setjoin, "RANGE_RUNS", ranges)
    monkeypatch.setattr(setjoin, "HOT_SETS", hot)
    rng = random.Random(int(least * 10))
    texts = []
    for _ in range(25):
        base = text(rng, rng.choice([8, 30, 150, 390, 450, 900, 1500]))
        texts += [base, *[edited(rng, base, rng.choice([0.01, 0.03, 0.06, 0.1])) for _ in range(3)]]
    phrases = [text(rng, 12) for _ in range(15)]  # texts of few phrases: every run is frequent
    texts += ["".join(rng.sample(phrases, 9)) for _ in range(60)]
    texts = list(dict.fromkeys(t for t in texts if len(t) >= 5))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {(r.a, r.b) for r in setjoin.candidate_links(df, least).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if likeness(texts[i], texts[j]) >= least}
    assert want and want <= got and len(got) < len(texts) ** 2 / 4


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert setjoin.candidate_links(df, 0.6).count() == 0
    assert setjoin.candidate_links(spark.createDataFrame([(1, "abc"), (2, "abc")], "id long, text string"), 0.6).count() == 0


def test_counts_are_added_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FAN", 2)
    texts = [text(random.Random(i), 60) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(7)
    counts = setjoin.bucket_counts(setjoin.sketched(df))
    assert counts.sum() == sum(len({t[i : i + 5] for i in range(len(t) - 4)}) for t in map(shingles.bare, texts))


def test_what_a_set_sends_is_bounded(spark):
    """However many ranges there are, a listed run costs at most its own 6 bytes and one head of 49 with the sketch."""
    texts = [text(random.Random(i), 390) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    table = setjoin.sketched(df)
    counts, sent = setjoin.bucket_counts(table), {}
    sizes = [len({t[i : i + 5] for i in range(len(t) - 4)}) for t in map(shingles.bare, texts)]
    listed = sum(n - -(-6 * n // 10) + 1 for n in sizes)
    for ranges in (1, 10, 100, 1000, 10_000):
        plan = setjoin.Plan(counts, 0.6)
        plan.ranges = ranges
        shared = spark.sparkContext.broadcast(plan)
        lists = table.where("piece IS NULL").select("id", "text", "sketch").mapInArrow(setjoin._prefix_batches(shared, 0.6), setjoin.LISTS)
        cols = [c.split()[0] for c in setjoin.LISTS.split(", ")][1:]
        sent[ranges] = lists.selectExpr("sum(" + " + ".join(f"length({c})" for c in cols) + ")").first()[0]
        assert sent[ranges] <= min(6 * listed + 49 * ranges * len(texts), 55 * listed)
    assert sent[10_000] < 1.2 * sent[1000]
