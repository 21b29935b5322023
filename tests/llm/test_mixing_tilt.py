from __future__ import annotations

import math

from docloom.llm.mixing import Mixing


def test_rates_are_tilted_by_size(spark):
    rows = [(i, s, "word " * (5 + 7 * (i % 30))) for i, s in enumerate(["a", "b"] * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = [(1, "a", 0.2, 1), (1, "b", 0.8, 1), (2, "a", 0.7, 3), (2, "b", 0.3, 2)]
    mix = Mixing(docs, spark.createDataFrame(t, "mix_id int, source string, target_share double, max_repeats int"))
    sizes = {}
    for r in mix.sizes.collect():
        sizes.setdefault(r.source, []).append(r.n_tokens)
    tilted = 0
    for p in mix.plans:
        if p["rate"] >= p["max_repeats"] * (1 - 1e-9):
            continue
        got = sum(n * min(p["max_repeats"], math.exp(p["b"] * n / p["mean"])) for n in sizes[p["source"]])
        assert p["done"] and abs(got / p["want"] - 1) < 1e-6
        assert p["b"] * (p["rate"] - 1) > 0  # below 1 long documents are thinned more, above 1 repeated more
        tilted += 1
    assert tilted == 2
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in mix.shares(mix.selection()).collect())
