from __future__ import annotations

import random

import pytest
import regex

from docloom.llm import packing, splitting, tokens


def check(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    upto = 0
    for i, (start, end, shared, _) in enumerate(got):
        assert 0 < end - start <= limit and 0 <= shared <= overlap and start == (upto - shared if i else 0) and end > upto
        upto = end
    assert upto == len(text)
    if len(text) > limit:
        stretch = bool(regex.search(r"[^\s\p{P}]{%d}" % (limit + 1), text))
        assert any(p[3] == 5 for p in got) == stretch


def test_split_covers_text():
    rng = random.Random(1)
    for _ in range(3000):
        limit = rng.choice([5, 20, 50])
        text = "".join(rng.choice(rng.choice(["abc", ["abcdefgh" * 6], " ", "。，\n", ["x" * 30], ["\n\n"], ["𠮷"]])) for _ in range(rng.randrange(150)))
        check(text, limit, rng.randrange(limit))
    for text in ("a" * 500 + "。" + "b" * 20, "a" * 501, "a" * 499 + "。" * 3 + "b" * 600 + " " + "c" * 700, "字" * 100_000):
        check(text, 500, 50)


def test_forced_cuts_overlap():
    got = splitting.split("字" * 1700, 500, 50)
    assert [p[:3] for p in got] == [(0, 500, 0), (450, 950, 50), (900, 1400, 50), (1350, 1700, 50)]


def test_split_prefers_high_boundaries():
    text = "一句。" * 100 + "\n" + "二句。" * 100
    assert [p[:2] for p in splitting.split(text, 400, 0)] == [(0, 301), (301, 601)]
    with pytest.raises(ValueError):
        splitting.split("a", 10, 10)


def test_sections_end_before_headings():
    body = "line of text\n" * 14
    for head in ("## Costs\n", "第三章 费用\n", "Chapter 3 Costs\n"):
        text = body + head + body
        assert [p[:2] for p in splitting.split(text, 300, 0)] == [(0, len(body)), (len(body), len(text))]


def test_pieces(spark, as_rows):
    long = "word " * 240
    rows = [(1, "d", 1, 1, long), (2, "d", 1, 2, long), (3, "d", None, None, "x" * 600), (4, "d", 2, None, None), (5, "d", 2, None, ""), (6, "d", 2, None, "s" * 500)]
    df = spark.createDataFrame(rows, "obj_id long, doc_id string, paragraph_index int, fragment_index int, content string")
    got = splitting.numbered(df, "obj_id", "content", "doc_id", "paragraph_index", ["fragment_index"])
    assert as_rows(got, "id", "number", "forced") == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (2, 4, 0), (2, 5, 0), (2, 6, 0), (3, 1, 1), (3, 2, 0)]
    assert all(len(r.piece) <= 500 for r in got.collect())
    assert splitting.pieces(df.limit(0), "obj_id", "content").count() == 0


def test_tokens(spark, as_rows):
    enc = tokens.encoder(tokens.VOCABULARY)
    hello = enc.encode_ordinary("hello world")
    assert enc.decode(hello) == "hello world" and tokens.count("") == 0 and tokens.count("hello world") == len(hello)
    long = "word and more " * 3000
    assert tokens.count(long) == len(enc.encode_ordinary(long))
    assert tokens.count("字" * 50_000) > 0
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, n_tokens int")
    assert as_rows(tokens.sized(df, ["doc_id"], "text")) == [(1, len(hello)), (2, 0), (3, 0)]


def test_best_fit_is_best():
    fit = packing.BestFit(10, 3)
    assert [fit.put(s) for s in (6, 5, 4, 3, 2)] == [0, 1, 0, 1, 1]
    fit = packing.BestFit(10, 2)
    assert [fit.put(s) for s in (7, 6, 9, 4)] == [0, 1, 2, 1]  # the bin of 7 closed for the one of 9


@pytest.mark.parametrize("shard_items", [50, 10_000])
def test_pack(spark, shard_items):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 3, 10, 40, 100, 260, 1000]) for i in range(600)} | {i: 33 for i in range(600, 900)}
    df = spark.createDataFrame([(i, s, 1, 2) for i, s in sizes.items()] + [(5000, None, 1, 2)], "doc_id long, n_tokens long, shard int, bin int")
    got = packing.pack(df, [(1, 100), (2, 400)], "doc_id", "n_tokens", shard_items).collect()
    for cap_id, capacity in ((1, 100), (2, 400)):
        rows = [r for r in got if r.cap_id == cap_id]
        bins, parts = {}, {}
        for r in rows:
            parts.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
            if r.container_id is not None:
                bins[r.container_id] = bins.get(r.container_id, 0) + r.n_tokens
        assert max(bins.values()) <= capacity and set(parts) == {*sizes, 5000}
        for i, s in sizes.items():
            p = sorted(parts[i])
            assert sum(n for _, n in p) == s and [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))]
            assert len(p) == 1 if s <= capacity else len(p) == -(-s // capacity)
        assert sum(sizes.values()) / (len(bins) * capacity) > 0.93
    assert packing.pack(df.limit(0), [(1, 5)], "doc_id", "n_tokens").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 0)], "doc_id", "n_tokens")
