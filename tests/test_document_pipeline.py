from __future__ import annotations

from docloom.operators import grid as G
from docloom.plans import pipeline as Q
from docloom.runtime import table
from docloom.sources import ooxml as X

DATA = "/root/testdata/sf0.001"


def test_word_files_hold_cells_and_pictures(spark, as_rows):
    parsed = X.read_word(Q._word_files(spark, DATA))
    blocks = table(spark, DATA, "blocks")
    own = blocks.where("kind = 'table'").selectExpr("doc_id", "concat('table_', table_no) AS table_id").distinct()
    cols = ["doc_id", "table_id", "r", "c", "coalesce(text, '') AS text", "grid_span", "v_merge"]
    want = G.dedup(table(spark, DATA, "cells").where("sheet IS NULL")).join(own, ["doc_id", "table_id"]).selectExpr(*cols)
    assert want.where("text <> ''").count() > 0 and as_rows(want.exceptAll(parsed.cells().selectExpr(*cols))) == []
    refs = table(spark, DATA, "image_refs").where("rel_id IS NOT NULL").join(blocks.select("doc_id", "block_pos").distinct(), ["doc_id", "block_pos"])
    cols = ["doc_id", "block_pos", "rel_id"]
    assert as_rows(parsed.images().select(*cols).distinct()) == as_rows(refs.select(*cols).distinct())


def test_all_kinds_reach_the_store(spark):
    got = Q.document_pipeline(spark, DATA).selectExpr("sum(tables) t", "sum(table_rows) r", "sum(images) i", "count_if(doc_id LIKE '%.xlsx') x").first()
    assert min(got) > 0
