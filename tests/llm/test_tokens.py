from __future__ import annotations

import os
import time

import pytest

from docloom.llm import tokens

DATA = "/root/testdata/sf0.1/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.isfile(tokens.VOCABULARY), reason="no vocabulary")


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_counts_are_those_of_whole_texts(spark):
    """Every document of sf0.1, long ones included, has as many tokens as its text encoded in one piece."""
    docs = spark.read.parquet(DATA)
    got = {r.doc_id: r.n_tokens for r in tokens.sized(docs, ["doc_id"], "text").collect()}
    enc = tokens.encoder(tokens.VOCABULARY)
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == (len(enc.encode_ordinary(r.text)) if r.text else 0)
    assert got[1836] == 56_928


def test_long_unbroken_stretches():
    began = time.time()
    for stretch in ("a", "=", " ", "\n", "字"):
        assert tokens.count(stretch * 500_000) > 0
    assert time.time() - began < 60 and tokens.count("") == 0
