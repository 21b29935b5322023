from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.packed import candidates, parse, parse_list
from docloom.operators.packed_fields import dialects, long_fields, unpack


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a, b；c|d\te\nf、g", list("abcdefg")),
        ("a / b/c / d", ["a", "b/c", "d"]),
        ('"""X""y，z"、w', ['"X"y，z', "w"]),
        ("‘a，b’;「c|d」; “e\nf”", ["a，b", "c|d", "e\nf"]),
        ("'l'échéance, dû', l'encours", ["l'échéance, dû", "l'encours"]),
        ('10" 管材|b', ['10" 管材', "b"]),
        ("8,944,325元, x（元，万）,y [1;2], 【a、b】", ["8,944,325元", "x（元，万）", "y [1;2]", "【a、b】"]),
        (", a,, b ,", ["", "a", "", "b", ""]),
        ("(a, b", ["(a", "b"]),
        ("“open, b", ["“open", "b"]),
        ("2019,2020", ["2019", "2020"]),
    ],
)
def test_plain(text, values):
    assert parse(text) == values


def test_marks_stand_outside_quotes():
    assert parse("1) a；2) “1) b，c”\n• d\n3、e\n（4）f\n1.5 g", marks=True) == ["a", "1) b，c", "d", "e", "f", "1.5 g"]


def test_lists():
    assert parse_list('["a, b", "c\\u00e9", null, 3]') == ["a, b", "cé", "", "3"]
    assert parse_list("['l\\'x', \"y\"]") == ["l'x", "y"]
    assert parse_list("[not a list") is None and parse_list("[a, b]") is None and parse_list('{"a": 1}') is None
    assert candidates('["a","b"]')[0] == ("list", [("a", True), ("b", True)])


_value = st.text(st.characters(codec="utf-8", categories=("Lu", "Ll", "Lo", "Nd")), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(_value, min_size=1, max_size=6), st.sampled_from([",", "；", "|", "\t", "\n", "、", " / ", " ; "]), st.sampled_from(["", '"', "“", "「", "'"]))
def test_round_trip(values, sep, quote):
    close = {"": "", '"': '"', "“": "”", "「": "」", "'": "'"}[quote]
    if not quote and sep == "," and any(v[-1].isdigit() for v in values):
        return  # digits around a bare comma may be one number
    assert parse(sep.join(f"{quote}{v}{close}" for v in values)) == values
    assert parse_list(json.dumps(values)) == values


def test_unpack(spark, as_rows):
    rows = [(1, "a, b", None, "1. x；2. y"), (2, "", " ", None), (3, '["p","q"]', "h1||h2", None), (3, '["p","q"]', "h1||h2", None), (4, None, None, None)]
    df = spark.createDataFrame([(*r, "v", "w") for r in rows], "obj_id long, keywords string, header string, key_information string, field string, value string")
    got = unpack(df, "obj_id", ["keywords", "header", "key_information"], frozenset(["key_information"]))
    want = [(1, "key_information", 1, "x"), (1, "key_information", 2, "y"), (1, "keywords", 1, "a"), (1, "keywords", 2, "b")]
    want += [(3, "header", 1, "h1"), (3, "header", 3, "h2"), (3, "keywords", 1, "p"), (3, "keywords", 2, "q")] * 2
    assert as_rows(got) == sorted(want)
    assert unpack(df.limit(0), "obj_id", ["keywords"]).count() == 0


def test_quotes_hold_against_known_halves(spark):
    """A quoted value with a separator inside stays whole, though its halves are well-known values and it is new."""
    fields = ["甲方;x"] * 30 + ["乙方;y"] * 30 + ["“甲方，乙方”;z", '"""甲方"",乙方";z', "'甲方|乙方', z", "1) 「甲方，乙方」"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(fields)], "obj_id long, f string")
    assert dialects(long_fields(df, "obj_id", ["f"]).select("field", "value"), frozenset(["f"])).count() == 0


def test_cheapest_dialect_is_learnt(spark):
    """Values known from the corpus outweigh the first dialect: here a comma between digits parts two well-known codes."""
    fields = ["100;x"] * 30 + ["200;y"] * 30 + ["100,200"] * 3 + ["7,500 t"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(fields)], "obj_id long, f string")
    chosen = dialects(long_fields(df, "obj_id", ["f"]).select("field", "value")).count()
    assert chosen == 1
    got = {(r["key"] if "key" in r else r["obj_id"], r["item"]) for r in unpack(df, "obj_id", ["f"]).where("obj_id >= 60").collect()}
    assert got == {(60, "100"), (60, "200"), (61, "100"), (61, "200"), (62, "100"), (62, "200"), (63, "7,500 t")}


def test_costs_decide(spark, as_rows):
    """Without the cost stage a field is one value; with it, values known and new are parted."""
    df = spark.createDataFrame([(1, "a, b；c"), (2, "one value"), (3, "“x, y”|z")], "obj_id long, f string")
    got = as_rows(unpack(df, "obj_id", ["f"]), "obj_id", "pos", "item")
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "one value"), (3, 1, "x, y"), (3, 2, "z")]
    assert as_rows(unpack(df, "obj_id", ["f"], costs=False), "obj_id", "item") == [(1, "a, b；c"), (2, "one value"), (3, "“x, y”|z")]


def test_search_finds_the_cheapest_of_all(spark):
    """The search, one switch at a time, ends at the cheapest of all candidate dialects, on every field of a table."""
    import os

    from docloom.operators.packed_fields import chosen, learnt

    path = "/root/testdata/sf0.001/chunk.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    marked = frozenset(["key_information"])
    values = long_fields(spark.read.parquet(path), "obj_id", ["keywords", "header", "key_information"]).select("field", "value").distinct()
    code = learnt(values, marked)
    for r in values.collect():
        a, b = (chosen(code, r.field, r.value, r.field in marked, every) for every in (False, True))
        assert [x for x, _ in a[2]] == [x for x, _ in b[2]] and round(code.parse(r.field, a[2]) - code.parse(r.field, b[2]), 6) == 0


def test_brackets_of_any_depth():
    deep = "(" * 50 + "a, b" + ")" * 50
    assert parse(f"{deep}, c") == [deep, "c"] and parse("(" * 50_000 + ", c") == ["(" * 50_000, "c"]
