"""The packed-field parser against a plain character-by-character reading of the rules."""

from __future__ import annotations

import ast
import json
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.packed import parse, parse_list

SEPARATORS = set(",，、;；|｜\t\n\r")
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」"}
BRACKETS = {"(": ")", "[": "]", "【": "】"}
MARK = re.compile(r"(?:[•●▪\-*–—]\s+|[•●▪]|\d{1,3}[)）]\s*|\d{1,3}、\s*|\d{1,3}\.(?!\d)\s*|[(（]\d{1,3}[)）]\s*|[①-⑳]\s*)")


def same(c):
    return {"（": "(", "）": ")"}.get(c, c)


def blank(c):
    return c.isspace() and c not in SEPARATORS


def separator(s, i):
    if i >= len(s):
        return False
    return s[i] in SEPARATORS or s[i] in "/／" and i > 0 and blank(s[i - 1]) and (i + 1 == len(s) or blank(s[i + 1]))


def skip(s, i):
    while i < len(s) and blank(s[i]):
        i += 1
    return i


def in_number(s, start, i):
    before = s[start:i].replace("，", ",")
    return s[i] in ",，" and re.search(r"(?<![0-9A-Za-z])\d{1,3}(?:,\d{3})*$", before) and re.match(r"[,，]\d{3}(?!\d)", s[i:])


def closing(s, i):
    """Place of the quote that closes the one at i: a separator or the end must follow it."""
    c, j = QUOTES[s[i]], i + 1
    while j < len(s):
        if s[j] == c:
            if c == '"' and s[j + 1 : j + 2] == '"':
                j += 2
                continue
            k = skip(s, j + 1)
            if k == len(s) or separator(s, k):
                return j
        j += 1
    return None


def bracket_end(s, i):
    o, depth = same(s[i]), 0
    for k in range(i, len(s)):
        depth += (same(s[k]) == o) - (same(s[k]) == BRACKETS[o])
        if depth == 0:
            return k
    return i


def plain_reading(s, mark):
    t = s.strip()
    if t.startswith("[") and t.endswith("]"):
        for f in (json.loads, ast.literal_eval):
            try:
                got = f(t)
            except (ValueError, SyntaxError):
                continue
            if isinstance(got, list):
                return [str(x).strip() for x in got]
    out, i = [], 0
    while True:
        i = skip(s, i)
        if mark and (m := MARK.match(s, i)):
            i = skip(s, m.end())
        j = closing(s, i) if i < len(s) and s[i] in QUOTES else None
        if j is not None:
            value, double = s[i + 1 : j], s[i] == '"'
            out.append((value.replace('""', '"') if double else value).strip())
            i = j + 1
        else:
            start = i
            while i < len(s) and (not separator(s, i) or in_number(s, start, i)):
                i = bracket_end(s, i) + 1 if same(s[i]) in BRACKETS else i + 1
            out.append(s[start:i].strip())
        i = skip(s, i)
        if i >= len(s):
            return out
        i += 1
        if i >= len(s):
            return [*out, ""]


def values(items):
    return [(k, x) for k, x in enumerate(items, 1) if x]


def both(s, mark):
    got = parse_list(s)
    return values(parse(s, "plain", mark) if got is None else got), values(plain_reading(s, mark))


DATA = "/root/testdata/sf0.01/chunk.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_on_the_tables():
    import pyarrow.parquet as pq

    t = pq.read_table(DATA, columns=["keywords", "header", "key_information"])
    for col in t.column_names:
        for s in t.column(col).unique().to_pylist():
            if s and s.strip():
                a, b = both(s, col == "key_information")
                assert a == b, s


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "税", "12", "345", "1", ",", "，", ";", "|", "、", " ", " / ", "/", "\n", '"', "“", "”", "'", "「", "」", "（元", "）", "[", "]"]), min_size=1, max_size=12).map("".join))
def test_on_random_fields(s):
    if s.strip():
        a, b = both(s, False)
        assert a == b
