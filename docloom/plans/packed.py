"""Problem 5: packed fields of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.packed import SEPARATORS
from docloom.operators.packed_fields import unpack
from docloom.runtime import table

FIELDS = ["keywords", "header", "key_information"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "chunk"), "obj_id", FIELDS, frozenset(["key_information"]))


#: What a plain field has none of: quote marks, brackets, commas between digits, line breaks and invisible characters at its ends.
_ODD = "[\"'＂＇`“”‘’„‚「」『』«»‹›〝〞｢｣()（）﹙﹚［］【】〖〗\\[\\]]|[0-9０-９][,，][0-9０-９]"


def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``p5_found``, the values of the fields keywords and header that hold no quote mark, bracket or comma between digits."""
    plain = table(spark, sf_dir, "chunk").select("obj_id", *[F.when(~F.col(f).rlike(_ODD), F.col(f)).alias(f) for f in FIELDS[:2]])
    return unpack(plain, "obj_id", FIELDS[:2])


_BLANK = r"[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
_SEPARATED = _BLANK + r"*[" + "".join(rf"\x{{{ord(c):x}}}" for c in SEPARATORS) + "]" + _BLANK + "*|" + _BLANK + "+[/／](?:" + _BLANK + "+|$)"
QUERIES = {"p5_found": p5_found, "p5_plain": p5_plain}
SQL: dict[str, str] = {
    "p5_plain": rf"""WITH v AS (SELECT obj_id, 'keywords' AS field, keywords AS value FROM chunk UNION ALL SELECT obj_id, 'header', header FROM chunk),
      s AS (SELECT obj_id, field, string_split_regex(value, '{_SEPARATED}') AS x FROM v WHERE value IS NOT NULL AND NOT regexp_matches(value, '{_ODD.replace("'", "''")}')),
      u AS (SELECT obj_id, field, unnest(range(1, len(x) + 1))::INT AS pos, unnest(x) AS raw FROM s)
      SELECT obj_id, field, pos, regexp_replace(raw, '^[\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]+|[\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]+$', '', 'g') AS item FROM u
      WHERE regexp_matches(raw, '[^\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]')""",
}
