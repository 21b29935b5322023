from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieve as R
from docloom.plans import retrieval as Q


def sides(spark, n=400):
    rng = random.Random(7)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))), i % 2, vec() if i % 9 else None) for i in range(n)]
    asked = [(1000 + i, " ".join(rng.sample("abcdefghxyz", 2)), i % 2, vec() if i else None, 3 + i) for i in range(6)]
    d = spark.createDataFrame(docs, "id long, text string, kb_id int, vector array<float>")
    q = spark.createDataFrame(asked, "qid long, text string, kb_id int, vector array<float>, k int")
    return d, q


@pytest.mark.parametrize("same", [None, "kb_id"])
def test_fusion_over_all_scores(spark, as_rows, same):
    d, q = sides(spark)
    keyword = R.bm25_scores(q, d, ["kb_id"] if same else None)
    v = R.vector_search(q.drop("k"), d, 400, same=same).selectExpr("qid", "id", "round(1 - distance, 6) AS score")
    want = R.top_k(R.fused(v, keyword).join(q.select("qid", "k"), "qid"), "qid", "score", "id", "k")
    got = R.hybrid_full(q, d, "k", same=same)
    shown = lambda df: [(*r[:3], round(r[3], 5)) for r in as_rows(df, "qid", "hit_rank", "id", "score")]
    assert shown(got) == shown(want) and got.count() == sum(range(3, 9))
    assert R.hybrid_full(q.limit(0), d).count() == 0 and R.hybrid_full(q, d.limit(0)).count() == 0
    assert R.hybrid_full(q, d.withColumn("text", F.lit("")), 2).count() == 10  # by vectors only, which one query lacks
    capped = R.hybrid_search(R.top_k(v, "qid", "score", "id", 20), R.top_k(keyword, "qid", "score", "id", 20), 8)
    assert as_rows(capped, "qid", "id") != as_rows(R.hybrid_full(q, d, 8, same=same), "qid", "id")


def test_terms_beyond_forty_characters_count(spark, tmp_path):
    texts = [(0, "common " * 10 + "zebra")] + [(i, {57: "zebra", 58: "zebra " + "filler " * 30}.get(i, "other")) for i in range(1, 99)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, 0.0], 0) for i in range(99)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {r.id: r.score for r in Q.hybrid_topk(spark, f"file://{tmp_path}").collect()}
    assert 57 in whole and len(whole) == 10


def test_vectors_of_several_lengths(spark, as_rows):
    """Queries of each length meet the vectors of their own length only."""
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, []), (5, None)], "id long, vector array<float>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 1.0, 0.0]), (12, None), (13, [])], "qid long, vector array<float>")
    assert as_rows(R.vector_search(q, d, 1), "qid", "id") == [(10, 1), (11, 3)]


def test_the_corpus_is_read_once_for_all_queries(spark, as_rows):
    """Whatever the number of passes over the scores, and of lengths of vectors among the queries."""
    d, q = sides(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = R.hybrid_full(q, d.mapInArrow(counted, d.schema), "k", same="kb_id")
    assert as_rows(got) == as_rows(R.hybrid_full(q, d, "k", same="kb_id")) and read.value == 400


def test_fusion_over_many_tiles(spark, as_rows):
    """More queries and rows of each kind than a tile holds, with ties, vectors of two lengths, rows without a vector or a text, and null kinds."""
    rng = random.Random(11)
    vec = lambda n: [float(rng.randrange(-9, 10)) for _ in range(n)]
    kind = lambda i: None if i % 50 == 0 else i % 2
    words = lambda n: " ".join(rng.choices("abcdefghijkl", k=n))
    docs = [(i, words(rng.randrange(0, 9)) if i % 13 else None, kind(i), vec(6 if i % 5 else 3) if i % 9 else None) for i in range(4600)]
    asked = [(10**6 + i, words(2), kind(i), vec(6 if i % 10 else 3) if i % 7 else None, i % 30) for i in range(360)]
    d = spark.createDataFrame(docs, "id long, text string, kb_id int, vector array<float>")
    q = spark.createDataFrame(asked, "qid long, text string, kb_id int, vector array<float>, k int")
    v = R.vector_search(q.drop("k"), d, 4600, same="kb_id").selectExpr("qid", "id", "round(1 - distance, 6) AS score")
    keyword = R.bm25_scores(q, d.where("text IS NOT NULL"), ["kb_id"])
    want = R.top_k(R.fused(v, keyword).join(q.select("qid", "k"), "qid"), "qid", "score", "id", "k")
    got = R.hybrid_full(q, d, "k", same="kb_id")
    shown = lambda df: [(*r[:2], round(r[2], 5)) for r in as_rows(df, "qid", "hit_rank", "score")]
    assert len(shown(got)) > 4000 and shown(got) == shown(want)
    assert len({*as_rows(got, "qid", "id")} ^ {*as_rows(want, "qid", "id")}) < 20  # of equal scores, sums in another order may differ in the last digit
