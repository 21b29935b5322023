"""Queries of the training-data problems, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import lookalike, packing, splitting
from docloom.llm.forest import dedup_batches
from docloom.llm.mixing import Mixing, source_name
from docloom.llm.neardup import NearDuplicates
from docloom.llm.quality import text_stats
from docloom.llm.tokens import sized
from docloom.runtime import table, written

LOOKALIKE_FIELDS = ["content", "keywords"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "chunk"), "obj_id", LOOKALIKE_FIELDS)


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(table(spark, sf_dir, "chunk"), "obj_id", LOOKALIKE_FIELDS)


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "chunk").where("chunk_type = 'text'"), "obj_id", "doc_id", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups().withColumnRenamed("id", "obj_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.pieces(table(spark, sf_dir, "chunk"), "obj_id", "content", with_text=False)
    return cut.groupBy(F.col("id").alias("obj_id")).agg(F.max("forced").alias("forced_cut"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.numbered(table(spark, sf_dir, "chunk"), "obj_id", "content", "doc_id", "paragraph_index", ["fragment_index"])
    return cut.withColumnsRenamed({"id": "obj_id", "para": "paragraph_index"})


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row that is cut: whether its pieces are its text's spans, fit the limit, cover it without a gap and overlap by no more than allowed."""
    rows = table(spark, sf_dir, "chunk").select(F.col("obj_id").alias("id"), "content")
    x = splitting.pieces(table(spark, sf_dir, "chunk"), "obj_id", "content").join(rows, "id")
    before = Window.partitionBy("id").orderBy("piece_no")
    x = x.withColumn("upto", F.coalesce(F.lag("end_pos").over(before), F.lit(0)))
    ok = lambda c: F.min(c.cast("int")) == 1
    whole = F.col("content").substr(F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) == F.col("piece")
    return x.groupBy(F.col("id").alias("obj_id")).agg(
        ok(whole).alias("are_spans"), ok(F.length("piece").between(1, splitting.LIMIT)).alias("fit"), ok(F.col("start_pos") == F.col("upto") - F.col("overlap")).alias("cover"),
        ok(F.col("overlap").between(0, splitting.OVERLAP)).alias("overlap_allowed"), F.max("end_pos").alias("end_pos"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batches(table(spark, sf_dir, "intake"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    # the four capacities are parameters, so they are read on the driver
    caps = [(r["cap_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "capacities").select("cap_id", "capacity_tokens").collect()]
    return packing.pack(docs, caps, "doc_id", "n_tokens")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(_packed(spark, sf_dir), table(spark, sf_dir, "capacities"))


def p6_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents that came out, containers over it, documents divided though they fit, and documents whose parts don't follow each other."""
    packed, caps = written(_packed(spark, sf_dir), "packed"), table(spark, sf_dir, "capacities").select("cap_id", "capacity_tokens")
    bins = packed.where("container_id IS NOT NULL").groupBy("cap_id", "container_id").agg(F.sum("n_tokens").alias("t")).join(caps, "cap_id")
    over = bins.groupBy("cap_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("cap_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("t"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last")).join(caps, "cap_id")
    out = docs.groupBy("cap_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("divided"), F.count_if(F.col("t") != F.col("last")).alias("broken")
    )
    return out.join(over, "cap_id")


def _mixing(spark: SparkSession, sf_dir: str) -> Mixing:
    return Mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = _mixing(spark, sf_dir)
    return mix.shares(mix.selection())


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: selected documents more often than allowed, of another source, or twice in the result; sources left without a settled rate."""
    mix = _mixing(spark, sf_dir)
    chosen = written(mix.selection(), "selection")
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("own"))
    want = table(spark, sf_dir, "mix_targets").select("mix_id", source_name(F.col("source")).alias("source"), "max_repeats")
    x = chosen.join(docs, "doc_id").join(want, ["mix_id", "source"])
    got = x.groupBy("mix_id").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("repeated"), F.count_if(F.col("own") != F.col("source")).alias("foreign"),
        (F.count(F.lit(1)) - F.count_distinct("source", "doc_id")).alias("twice"),
    )
    return got.join(mix.shares(chosen).groupBy("mix_id").agg(F.count_if(~F.col("settled")).alias("unsettled")), "mix_id")


def p8_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain figures of ``p8_stats``."""
    plain = ["mean_word_length", "short_lines", "duplicate_lines"]
    return p8_stats(spark, sf_dir).select("doc_id", "n_chars", "word_count", "line_count", "longest_word", *[F.round(c, 6).alias(c) for c in plain])


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_stats(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_valid": p3_valid, "p4_found": p4_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_valid": p6_valid, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_valid": p7_valid, "p8_found": p8_found, "p8_stats": p8_stats, "p8_figures": p8_figures}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shown_sql(c: str) -> str:
    """The look-alike form of a column in SQL: mapped character by character, then composed."""
    m = {k: v for k, v in lookalike.maps()[0].items() if k >= " "}
    keep, drop = [k for k in m if m[k]], [k for k in m if not m[k]]
    for a, b in lookalike.LIGATURES.items():
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize(translate({c}, {_quoted(''.join(keep + drop))}, {_quoted(''.join(m[k] for k in keep))}))"


_LIKE = rf"""t AS (SELECT obj_id, doc_id, regexp_replace({_shown_sql("content")}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g') AS x FROM chunk WHERE chunk_type = 'text' AND length(content) >= 120),
  g AS (SELECT obj_id, doc_id, unnest(list_distinct(list_transform(range(1, length(x) - 3), lambda i: substr(x, i::BIGINT, 5)))) AS run FROM t WHERE length(x) >= 5),
  n AS (SELECT obj_id, count(*) AS n FROM g GROUP BY obj_id),
  o AS (SELECT a.obj_id AS obj_a, b.obj_id AS obj_b, count(*) AS both_n FROM g a JOIN g b ON a.run = b.run AND a.obj_id < b.obj_id AND a.doc_id IS DISTINCT FROM b.doc_id GROUP BY a.obj_id, b.obj_id)"""
_BARE = rf"regexp_replace({_shown_sql('content')}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g')"


def _links_sql(texts: str) -> str:
    """CTEs from ``texts`` (id, x) to links (a, b), a < b, of a likeness of at least 0.6."""
    return f"""t AS ({texts}),
      g AS (SELECT id, unnest(list_distinct(list_transform(range(1, length(x) - 3), lambda i: substr(x, i::BIGINT, 5)))) AS run FROM t WHERE length(x) >= 5),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      o AS (SELECT a.id AS a, b.id AS b, count(*) AS both_n FROM g a JOIN g b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id),
      links AS (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE both_n / (p.n + q.n - both_n) >= 0.6)"""


_SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
SQL = {
    "p2_groups": f"""WITH RECURSIVE m AS (SELECT obj_id, {_BARE} AS x FROM chunk WHERE chunk_type = 'text' AND length(content) >= 120), {_links_sql("SELECT min(obj_id) AS id, x FROM m WHERE length(x) >= 5 GROUP BY x")},
      pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT id, id AS r FROM t UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r)
      SELECT obj_id, (SELECT min(r) FROM reach WHERE reach.id = t.id) AS class_id, (SELECT count(*) FROM pairs WHERE pairs.a = t.id) AS links FROM m JOIN t ON t.x = m.x""",
    "p4_found": f"""WITH RECURSIVE {_links_sql(f"SELECT item_id AS id, {_BARE} AS x FROM intake WHERE length(content) >= 120")},
      ends AS (SELECT a AS id FROM links UNION SELECT b FROM links),
      s AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a) FROM links WHERE links.b = ends.id), []) AS near FROM ends),
      walk(k, accepted, id, kept) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
        UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(accepted, id) ELSE accepted END, id, hit FROM (
          SELECT s.k, s.id, w.accepted, list_min(list_filter(s.near, lambda a: list_contains(w.accepted, a))) AS hit FROM walk w JOIN s ON s.k = w.k + 1))
      SELECT kept AS kept_id, id AS item_id FROM walk WHERE kept IS NOT NULL""",
    "p3_valid": "SELECT obj_id, true AS are_spans, true AS fit, true AS cover, true AS overlap_allowed, length(content)::INT AS end_pos FROM chunk WHERE length(content) > 500",
    "p6_valid": "SELECT cap_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS divided, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM capacities",
    "p7_valid": "SELECT DISTINCT mix_id, 0::BIGINT AS repeated, 0::BIGINT AS foreign, 0::BIGINT AS twice, 0::BIGINT AS unsettled FROM mix_targets",
    "p8_figures": rf"""WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines,
        regexp_extract_all(text, '[A-Za-z\x{{c0}}-\x{{24f}}]+') AS words, list_filter(string_split_regex(text, '[{_SPACE}]+'), lambda w: w <> '') AS tokens FROM documents WHERE regexp_matches(text, '[^\s\p{{Z}}]'))
      SELECT doc_id, length(text)::INT AS n_chars, (len(words) + length(regexp_replace(text, '[^\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{2ffff}}]', '', 'g')))::INT AS word_count, len(lines)::INT AS line_count,
        coalesce(list_max(list_transform(tokens, lambda w: length(w))), 0)::INT AS longest_word, round(coalesce(list_avg(list_transform(words, lambda w: length(w))), 0.0), 6) AS mean_word_length,
        round(len(list_filter(lines, lambda l: length(l) <= 30)) / len(lines), 6) AS short_lines,
        round(1 - len(list_distinct(list_transform(lines, lambda l: regexp_replace(l, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')))) / len(lines), 6) AS duplicate_lines FROM d""",
    "p1_found": rf"""WITH v AS (SELECT obj_id, 'content' AS field, content AS value FROM chunk UNION ALL SELECT obj_id, 'keywords', keywords FROM chunk),
      s AS (SELECT *, {_shown_sql("value")} AS shown FROM v WHERE value IS NOT NULL)
      SELECT DISTINCT a.field, a.obj_id AS obj_a, b.obj_id AS obj_b FROM s a JOIN s b ON a.field = b.field AND a.shown = b.shown AND a.value <> b.value AND a.obj_id < b.obj_id
      WHERE length(regexp_replace(a.shown, '[\s\p{{Z}}\x0b\x85]+', '', 'g')) > 0""",
    "p2_found": f"""WITH {_LIKE} SELECT obj_a, obj_b FROM o JOIN n p ON p.obj_id = obj_a JOIN n q ON q.obj_id = obj_b WHERE both_n / (p.n + q.n - both_n) >= 0.6""",
    "p3_found": r"SELECT obj_id, regexp_matches(content, '[^\s\p{Z}\p{P}\x0b\x1c-\x1f\x85]{501}')::INT AS forced_cut FROM chunk WHERE length(content) > 500",
}
