from __future__ import annotations

import random

from docloom.llm import quality
from docloom.llm.mixing import Mixing


def docs(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, rng.choices(["big", "MID ", "tiny", None, "big-two"], [60, 30, 3, 2, 5])[0], "word " * rng.randrange(1, 120)) for i in range(n)]
    rows += [(n, "tiny", "word " * 50_000), (n + 1, "big", ""), (n + 2, "big", None)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, key int, copies int")


def test_mix(spark):
    t = [(1, "big", 0.5, 1), (1, "mid", 0.3, 1), (1, "tiny", 0.2, 4), (2, "mid", 0.6, 2), (2, "nowhere", 0.4, 5), (3, "big_two", 1.0, 3), (4, "big", 0.9, 1), (4, "tiny", 0.1, 1)]
    mix = Mixing(docs(spark), spark.createDataFrame(t, "mix_id int, source string, target_share double, max_repeats int"))
    got = {(r.mix_id, r.source): r for r in mix.shares(mix.selection()).collect()}
    assert len(got) == len(t) and all(r.most_copies <= r.max_repeats for r in got.values())
    for mix_id in (1, 3, 4):
        for (m, _), r in got.items():
            if m == mix_id:
                assert abs(r.actual_share - r.target_share) < 0.01, r
    assert got[2, "nowhere"].actual_share == 0 and got[2, "mid"].actual_share == 1
    assert got[1, "tiny"].most_copies == 4  # the scarce source is used in full


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "mix_id int, source string, target_share double, max_repeats int")
    mix = Mixing(docs(spark, 20), none)
    assert mix.selection().count() == 0 and mix.shares(mix.selection()).count() == 0
    t = spark.createDataFrame([(1, "big", 1.0, 2)], "mix_id int, source string, target_share double, max_repeats int")
    mix = Mixing(docs(spark, 20).limit(0), t)
    assert mix.shares(mix.selection()).collect()[0].actual_share == 0


COMMON = frozenset(["the", "of", "and", "to", "in", "a", "was", "by", "的", "了", "是", "在", "和", "与", "由"])
PROSE = "The audited budget fell by three percent because of bad weather. The board was asked to review the plan, and it agreed. "
KINDS = {
    "prose": [PROSE * 2, "会上要求人力科在五月前公示排产计划，并归档图纸目录。财务部认为与季节有关，留待下期复查。" * 2, "The audited budget fell by three\npercent because of bad weather. The\nboard was asked to review the plan,\nand it agreed with the\nfinance desk in the end.", "Heading\n- one\n- two\n" + PROSE * 3],
    "list": ["\n".join(f"- item number {i}" for i in range(12)), "\n".join(f"（{i}）设备{i}科目录；" for i in range(9)), "\n".join(f"[x] 整改{'甲乙丙丁戊己'[i]}方案" for i in range(6)), "\n".join(f"Chapter {'abcdefgh'[i]} .......... {i * 3}" for i in range(8))],
    "table": ["| a | b |\n| --- | --- |\n" + "\n".join(f"| x{i} | {i * 7} |" for i in range(8)), "\n".join(f"name{i}\t{i * 31}\t{i}%" for i in range(8)), "\n".join(f"row{i},{i * 17},{i}.5" for i in range(8)), "\n".join(f"日期=2024-01-0{i} 数量={i * 3} 单价={i}" for i in range(1, 8))],
    "junk": ["ha" * 200, "Home | Next | Print | Home | Next | Home | Print | Next | Home | Print | Next", "\n".join(f"[DEBUG] 0x{i * 7919:012x} abc:{i}" for i in range(9)), "ä¸ºä»\x80ä¹\x88å¹³å\x9d\x87å\x81¿è¿\x98é¢\x9då°\x8få¹\x85", "{¤\\==/¤<|%_&[*^*^}&&>*~>$>%\\/!\\~\\¬¬|}^|+|°&&$*%@^/+|>^+^]]#/>+|~", "税后 订单量 走低 期末 存货 反弹 库龄 累计 翻番 回落 物流 金属 名义 折旧 边际 上升 仪表 客单价 下滑 种业 峰值 在建"],
}


def test_kinds():
    for want, texts in KINDS.items():
        for t in texts:
            s = quality.stats(t, COMMON)
            assert quality.kind(s) == want, (want, t[:60], s)


def test_stats(spark, as_rows):
    rows = [(1, PROSE), (2, None), (3, ""), (4, " \n　"), (5, "x"), (5, "x"), (6, "a" * 300_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, doc_kind string")
    words = spark.createDataFrame([("en", "the"), ("en", None), ("en", "of")], "lang string, word string")
    got = quality.text_stats(df, "doc_id", "text", words)
    assert as_rows(got, "doc_id") == [(1,), (5,), (5,), (6,)]
    one = got.where("doc_id = 1").first()
    assert one.word_count == 22 and one.ended_lines == 1.0 and one.doc_kind == "prose" and 0 < one.symbol_ratio < 0.1 and one.common_share > 0.1
    assert got.where("doc_id = 6").first().doc_kind == "junk"
    assert quality.text_stats(df.limit(0), "doc_id", "text", words).count() == 0


def test_repetition_figures():
    s = quality.stats("same line\nsame line\nother\n\nsame line\nsame line\nother", COMMON)
    assert abs(s["duplicate_lines"] - 4 / 6) < 1e-9 and s["duplicate_paragraphs"] == 0.5 and s["dominant_ngram"] > 0.4
