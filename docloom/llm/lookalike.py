"""Problem 1: text that looks the same is stored in different characters.

Values are mapped by ``translate`` in the JVM (character width, invisible characters, kinds of blank, look-alike letters
and signs, ligatures), then grouped under the accent-sensitive, case-sensitive Unicode collation, which also makes
composed and split accents equal. One member of a class is its canonical form; it is joined back to all members.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread, written

#: Up to so many characters of differing values are broadcast to be joined back; beyond, they are joined by shuffle.
BROADCAST_CHARS = 16_000_000
# Look-alike letters of Greek and Cyrillic and the Latin letters they look like, by position.
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc"
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝӏ", "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwl"
# Capitals of Cherokee, Lisu and Coptic and letters of Armenian that are drawn as Latin letters.
_CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"
_LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
_COPTIC = "ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟ", "ABHIKMNOPCTYXo"
_ARMENIAN = "ՕՏօոսհ", "OSonuh"
# Look-alike signs.
_SIGNS = "‐‑⁃−﹣∶ː꞉∕⁄⧸∣ǀ‚․ꓸ", "-----:::///||,.."
# Radicals of the CJK supplement that show the same figure as an ideograph (no decomposition exists).
_RADICALS = (
    "⺁⺅⺆⺊⺎⺐⺒⺓⺖⺘⺙⺛⺝⺠⺡⺣⺤⺨⺩⺬⺭⺮⺯⺰⺼⺽⺾⻁⻂⻃⻄⻅⻈⻉⻊⻋⻌⻐⻑⻒⻓⻔⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱",
    "厂亻冂卜兀尢巳幺忄扌攵旡月民氵灬爫犭王示礻竹糹纟肉臼艹虎衤覀西见讠贝足车辶钅長镸长门雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙亀",
)
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}


@lru_cache(maxsize=1)
def maps() -> tuple[dict[str, str], dict[str, str]]:
    """(look-alike map, coarse map): character to one character, or to "" where it is dropped.

    The coarse map also drops accents; equal texts have equal coarse forms, so it serves to find candidates.
    """
    fine: dict[str, str] = {}
    for a, b in (_GREEK, _CYRILLIC, _CHEROKEE, _LISU, _COPTIC, _ARMENIAN, _SIGNS, _RADICALS):
        fine.update(zip(a, b, strict=True))
    bases: dict[str, str] = {}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs") or ch in fine:
            continue
        if cat == "Zs":
            fine[ch] = " "
        elif cat == "Cf" and cp not in _VISIBLE_FORMAT or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D, 0x180F, 0x17B4, 0x17B5):
            fine[ch] = ""
        elif 0xFE00 <= cp <= 0xFE0F or cat == "Cc" and cp != 0x85:
            fine[ch] = ""
        else:
            tag, _, to = (d := unicodedata.decomposition(ch)).rpartition("> ")
            parts = to.split()
            if tag in ("<wide", "<narrow", "<small") or tag == "<compat" and 0x2E80 <= cp < 0x2FE0:
                one = unicodedata.normalize("NFKC", ch)
                if len(one) == 1:
                    fine[ch] = fine.get(one, one)
            elif d and not tag and len(parts) == 1:  # another code point of the very same character
                one = unicodedata.normalize("NFC", ch)
                if len(one) == 1:
                    fine[ch] = fine.get(one, one)
            elif d and not tag:
                bases[ch] = unicodedata.normalize("NFD", ch)[0]
            elif cat == "Mn" and unicodedata.combining(ch):
                bases[ch] = ""
    for cp in (*range(0x20), 0x7F, *range(0xE0000, 0xE01F0)):
        if cp not in (9, 10, 11, 12, 13):
            fine[chr(cp)] = ""
    for cp in range(0x2F800, 0x2FA1E):  # compatibility ideographs beyond the basic plane
        one = unicodedata.normalize("NFC", chr(cp))
        if len(one) == 1:
            fine[chr(cp)] = one
    coarse = dict(fine)
    for ch, b in bases.items():
        coarse[ch] = fine.get(b, b)
    for cp in range(0xAC00, 0xD7A4):
        coarse[chr(cp)] = unicodedata.normalize("NFD", chr(cp))[0]
    coarse.update({chr(cp): "" for cp in range(0x1160, 0x1200)})
    # a map's results are final: none is itself mapped
    return ({k: fine.get(v, v) for k, v in fine.items() if k != v}, {k: coarse.get(v, v) for k, v in coarse.items() if k != v})


def _translate(c: Column, m: dict[str, str]) -> Column:
    keep = [k for k, v in m.items() if v]
    drop = [k for k, v in m.items() if not v]
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(keep) + "".join(drop), "".join(m[k] for k in keep))


def mapped(c: Column) -> Column:
    """The look-alike-mapped text; equal under the UNICODE collation iff the texts look the same."""
    return _translate(c, maps()[0])


def _coarse(c: Column) -> Column:
    return _translate(c, maps()[1])


def _unchanged(c: Column) -> Column:
    """The characters of a value that the map leaves as they are."""
    return F.translate(c, "".join([*maps()[0], *LIGATURES]), "")


def normal_form(text: str) -> str:
    """The same form for one Python string: mapped and composed."""
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    return unicodedata.normalize("NFC", text.translate(str.maketrans(maps()[0])))


def long_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value, coarse) of each value that shows something; nulls and blanks are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = spread(df.select(key, *fields)).select(F.col(key).alias("key"), F.explode(pairs).alias("x")).select("key", "x.field", "x.value").where("value IS NOT NULL")
    rows = rows.withColumn("coarse", _coarse(F.col("value")))
    return rows.where(F.col("coarse").rlike(r"[^\s]")).withColumn("coarse", F.xxhash64("coarse"))


def _suspects(rows: DataFrame) -> DataFrame:
    """The rows of coarse forms that occur as more than one string."""
    h = F.xxhash64("value")
    several = rows.groupBy("field", "coarse").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("field", "coarse")
    return written(rows.join(several, ["field", "coarse"], "left_semi"), "lookalike-suspects")


def _variants(suspects: DataFrame) -> DataFrame:
    """(field, variant, canonical) of each string that looks like another string of its field.

    The canonical member is the one with the fewest characters that the map changes, then the shortest (composed accents
    before split ones), then the least in binary order; all over the whole value.
    """
    spark = suspects.sparkSession
    variants = suspects.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", mapped(F.col("value")))
    variants = variants.withColumn("changed", F.length("value") - F.length(_unchanged(F.col("value"))))
    classes = spark.sql(
        """SELECT field, min(shown) AS shown,
                  min_by(value, struct(changed, length(value), value)) AS canonical
           FROM (SELECT field, value, shown, changed, shown COLLATE UNICODE AS look FROM {variants})
           GROUP BY field, look HAVING count(*) > 1""",
        variants=variants,
    )
    return spark.sql(
        """SELECT v.field, v.value, v.n, c.canonical FROM {variants} v
           JOIN {classes} c ON v.field = c.field AND v.shown COLLATE UNICODE = c.shown COLLATE UNICODE""",
        variants=variants,
        classes=classes,
    )


def canonical(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, canonical): each value that shows something, in the one form of its class.

    A value that no other string looks like is its own class. Nulls and blank values give no row; repeated rows give one
    row each; ties between members go to the least string. Other columns of ``df`` aren't read.
    """
    rows = long_values(df, key, fields)
    variants = written(_variants(_suspects(rows)).where("canonical <> value").select("field", "value", "canonical"), "lookalike-variants")
    size = variants.agg(F.sum(F.length("value") + F.length("canonical"))).first()[0] or 0
    if size <= BROADCAST_CHARS:  # else all texts are shuffled once
        variants = F.broadcast(variants)
    out = rows.join(variants, ["field", "value"], "left").select("key", "field", F.coalesce("canonical", "value").alias("canonical"))
    return out.withColumnRenamed("key", key)


def alike_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, obj_a, obj_b), obj_a < obj_b: the pairs of rows whose values look the same but aren't the same string.

    Pairs are made between the differing strings of a class only, so copies of one string meet no copy of it. Nulls and
    blanks give none; a key that occurs twice is one object.
    """
    suspects = _suspects(long_values(df, key, fields))
    h = F.xxhash64("field", "value")
    variants = _variants(suspects).select("field", h.alias("string"), F.xxhash64("field", "canonical").alias("class"))
    members = suspects.select("field", "key", h.alias("string")).distinct().join(variants, ["field", "string"])
    a = members.select("field", "class", F.col("string").alias("sa"), F.col("key").alias("obj_a"))
    b = members.select("field", "class", F.col("string").alias("sb"), F.col("key").alias("obj_b"))
    return a.join(b, ["field", "class"]).where("obj_a < obj_b AND sa <> sb").select("field", "obj_a", "obj_b").distinct()
