from __future__ import annotations

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lookalike as L

SCHEMA = "obj_id long, content string, keywords string, value string, coarse string"


def table(spark, values):
    return spark.createDataFrame([(i, v, None, "x", "y") for i, v in enumerate(values)], SCHEMA)


SAME = [
    ["abc é 1-2", "аbс é 1-2", "ａbc é １-２", "abc​ é 1-2", "abc é 1‐2", "abc　é 1-2", "a﻿b­c é 1‑2"],
    ["年人车ﬁnal", "年⼈⻋final"],
    ["K", "K", "К"],
    ["（a），；", "(a),;"],
]
OTHER = ["abc e 1-2", "Abc é 1-2", "abc  é 1-2", "abcé 1-2", "abc\né 1-2", "2", "²", "②", "𠮷", "吉", "", " ​", None]


def test_pairs(spark, as_rows):
    values = [v for g in SAME for v in g] + OTHER + [SAME[1][0], OTHER[0]]
    group = {v: i for i, g in enumerate(SAME) for v in g}
    want = [("content", i, j) for i, j in itertools.combinations(range(len(values)), 2) if values[i] in group and group[values[i]] == group.get(values[j]) and values[i] != values[j]]
    assert as_rows(L.alike_pairs(table(spark, values), "obj_id", ["content", "keywords"])) == want


def test_canonical(spark):
    values = [v for g in SAME for v in g] + OTHER
    got = {r.obj_id: r.canonical for r in L.canonical(table(spark, values), "obj_id", ["content"]).collect()}
    for g in SAME:
        forms = {got[values.index(v)] for v in g}
        assert len(forms) == 1 and forms <= set(g)
    for v in OTHER[:-3]:
        assert got[values.index(v)] == v
    assert not {values.index(v) for v in OTHER[-3:]} & set(got)


def test_empty_and_repeated(spark):
    assert L.alike_pairs(table(spark, []), "obj_id", ["content"]).count() == 0
    df = table(spark, ["a", "а"])
    assert L.alike_pairs(df.union(df), "obj_id", ["content"]).count() == 1
    assert L.canonical(df.union(df), "obj_id", ["content"]).count() == 4


def test_hot_group(spark):
    """A third of all rows hold one string; it meets only the few that differ."""
    values = ["hot é"] * 300 + ["hot é"] * 2 + [f"other {i}" for i in range(600)]
    assert L.alike_pairs(table(spark, values), "obj_id", ["content"]).count() == 600


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_normal_form_is_stable(text):
    once = L.normal_form(text)
    assert L.normal_form(once) == once
