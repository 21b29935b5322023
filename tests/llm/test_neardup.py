from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import shingles
from docloom.llm.components import components
from docloom.llm.forest import HashForest, dedup_batches, depth_for, recall
from docloom.llm.neardup import NearDuplicates
from tests_llm_texts import edited, likeness, text


def corpus(seed, families=40, singles=60):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = text(rng)
        out += [base, *[edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08, 0.12])) for _ in range(rng.randrange(1, 5))]]
    out += [text(rng) for _ in range(singles)]
    rng.shuffle(out)
    return out


def test_runs_and_likeness():
    h, off = shingles.runs(["abcdef", "", "abc", "aaaaaaaa", "abcdef"])
    assert list(np.diff(off)) == [2, 0, 0, 1, 2] and list(h[:2]) == list(h[3:5])
    assert shingles.likeness(["abcdef", "", "x"], ["abcdeg", "", "x"]).tolist() == [1 / 3, 0, 0]


def test_minhash_estimates_likeness():
    rng = random.Random(1)
    base = text(rng, 600)
    t = [base, edited(rng, base, 0.05)]
    h, off = shingles.runs(t)
    m = shingles.minhashes(h, off, 1024)
    assert abs((m[:, 0] == m[:, 1]).mean() - likeness(*t)) < 0.06


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_brute_force(spark, seed):
    texts = corpus(seed)
    docs = [f"d{i % 7}" if i % 11 else None for i in range(len(texts))]
    rows = [(i, docs[i], t, "text", 1) for i, t in enumerate(texts)] + [(9001, "d", None, "text", 1), (9002, "d", "short", "text", 1), (9003, "d", " " * 200, "text", 1)]
    df = spark.createDataFrame(rows + rows[:3], "obj_id long, doc_id string, content string, text string, id int")
    n = NearDuplicates(df, "obj_id", "doc_id", "content")
    got = {(r.obj_a, r.obj_b) for r in n.pairs().collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if min(len(texts[i]), len(texts[j])) >= 120 and docs[i] != docs[j] and likeness(texts[i], texts[j]) >= 0.6}
    assert len(want) > 20 and got == want
    groups = {r.id: r for r in NearDuplicates(df, "obj_id", "doc_id", "content").groups().collect()}
    assert set(groups) == {i for i, t in enumerate(texts) if len(t) >= 120}
    assert all(groups[a].class_id == groups[b].class_id for a, b in want)


def test_hot_copies(spark):
    """A third of the rows are copies of one text of one document: they are one leader."""
    rng = random.Random(3)
    hot = text(rng)
    rows = [(i, "same", hot) for i in range(200)] + [(1000 + i, f"d{i}", text(rng)) for i in range(400)] + [(5000, "else", edited(rng, hot, 0.01))]
    df = spark.createDataFrame(rows, "obj_id long, doc_id string, content string")
    n = NearDuplicates(df, "obj_id", "doc_id", "content")
    assert n.links().count() == 1 and n.pairs().count() == 200


def test_empty(spark):
    df = spark.createDataFrame([], "obj_id long, doc_id string, content string")
    n = NearDuplicates(df, "obj_id", "doc_id", "content")
    assert n.pairs().count() == 0 and n.groups().count() == 0


def test_components(spark, as_rows):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (102, 101)]
    got = dict(as_rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 104)} == {100}


def greedy(items):
    kept, out = [], []
    for i, t in sorted(items):
        if t is None or len(t) < 120:
            continue
        near = [k for k, u in kept if likeness(u, t) >= 0.6]
        if near:
            out.append((min(near), i))
        else:
            kept.append((i, t))
    return sorted(out)


@pytest.mark.parametrize("per_ingest", [1, 3])
def test_batches_match_brute_force(spark, as_rows, per_ingest):
    texts = corpus(7, 25, 30)
    items = [(i, t) for i, t in enumerate(texts, 1)] + [(900, None), (901, "short"), (902, "\n" * 300)]
    rows = [(i, None if i == 3 else min(5, i // 30), t, "d") for i, t in items]
    df = spark.createDataFrame(rows + rows[:2], "item_id long, batch_no int, content string, text string")
    assert as_rows(dedup_batches(df, per_ingest=per_ingest)) == greedy(items)
    assert dedup_batches(df.limit(0)).count() == 0


def test_history_is_kept_and_merged(spark, as_rows):
    texts = corpus(9, 12, 10)
    forest = HashForest(spark)
    got, step = [], 8
    for at in range(0, len(texts), step):
        batch = spark.createDataFrame([(i, texts[i]) for i in range(at, min(len(texts), at + step))], "item_id long, content string")
        got += as_rows(forest.ingest(batch))
    assert sorted(got) == greedy(list(enumerate(texts))) and len(forest.runs) <= 5


def test_depth():
    assert depth_for(0.6, 0.9995, trees=64) == 4 and recall(0.6, 4, 64) >= 0.9995 and depth_for(0.95, 0.9995) == 5
    assert depth_for(0.6, 0.9995) == 3 and recall(0.6, 3) >= 0.9995


def test_forest_is_taken_up_again(spark, as_rows, tmp_path):
    """A new forest at the same path knows the history; a batch whose ids aren't above it is an error, and so are other parameters."""
    texts = corpus(11, 12, 10)
    half, got = len(texts) // 2, []
    for part in (range(half), range(half, len(texts))):
        batch = spark.createDataFrame([(i, texts[i]) for i in part], "item_id long, content string")
        got += as_rows(HashForest(spark, f"file://{tmp_path}/forest").ingest(batch))
    assert sorted(got) == greedy(list(enumerate(texts)))
    with pytest.raises(ValueError):
        HashForest(spark, f"file://{tmp_path}/forest").ingest(batch)
    with pytest.raises(ValueError):
        HashForest(spark, f"file://{tmp_path}/forest", least=0.7)


def test_a_small_batch_reads_a_small_part(spark, monkeypatch):
    """A batch's search reads from the sorted runs shelves in proportion to its signatures, not the whole index."""
    from docloom.llm import forest as forests

    monkeypatch.setattr(forests, "SHELF_ROWS", 250)
    rng = random.Random(21)
    forest = HashForest(spark)
    forest.ingest(spark.createDataFrame([(i, text(rng)) for i in range(1000)], "item_id long, content string"))
    every = forest._read("index", forests._INDEX).count()
    assert every == 1000 * forests.TREES
    read = {}
    for n in (1, 8):
        rows = spark.createDataFrame([(10_000 + i, text(rng)) for i in range(n)], "id long, text string")
        lead = rows.mapInArrow(shingles.signature_batches(forests.TREES, forests.PER_TREE, forests.BITS), shingles.SIGNATURE)
        found = forest.near(forests.postings_of(lead), n)
        found.collect()
        read[n] = sum(leaf.metrics().apply("numOutputRows").value() for leaf in _leaves(found))
    assert read[1] <= 40 * 1000 / 4 * 1.5 and read[1] < read[8] <= every  # 32 signatures, as many shelves of about 250 rows


def _leaves(df):
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]
