"""Problem 2: groups of near-duplicate texts in a collection too large for pairwise comparison.

Sets of distinct five-character runs are joined by likeness, by way of relations between sets. Equal sets come first: a
copy's answers are its leader's, so only leaders enter the index. The index is made of inverted lists whose blocks are
skipped by position and size (``setjoin``); what may still be a link is checked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import candidates as C
from docloom.llm import setjoin
from docloom.llm.components import components
from docloom.llm.lookalike import mapped
from docloom.runtime import spread, written

LIKENESS, LEAST_CHARS = 0.6, 120


class NearDuplicates:
    """The join of one table: members (id, doc, text_hash), leaders and links between leaders of different texts.

    Rows with null or shorter text, and texts without a run of five characters, take no part. Ids that occur twice are
    one member. ``doc`` may be null: null differs from every name and equals null.
    """

    def __init__(self, df: DataFrame, key: str, doc: str, text: str, least_chars: int = LEAST_CHARS, least: float = LIKENESS):
        self.least = least
        self.rows = df.where(F.length(text) >= least_chars).select(F.col(key).cast("long").alias("id"), F.col(doc).alias("doc"), F.col(text).alias("text"))
        shown = spread(self.rows.select("id", "text")).select("id", mapped(F.col("text")).alias("text"))
        self.table = setjoin.sketched(shown)
        self.texts = self.table.where("piece IS NULL")
        self.members = self.texts.select("id", "text_hash").distinct()

    def leaders(self) -> DataFrame:
        """One row per text, that of the least id; ids that occur twice come once."""
        copies = self.members.groupBy("text_hash").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
        followers = written(self.members.join(copies, "text_hash").where("id <> leader").select("id"), "followers")
        return self.texts.select("id", "text", "size", "sketch", "parity").join(C.checked(followers), "id", "left_anti")

    def links(self) -> DataFrame:
        """(a, b, likeness), a < b: the links between leaders, written once."""
        pairs = setjoin.links_of(self.table, self.leaders(), self.least)
        texts = self.texts.select("id", "text")
        return written(C.verified(pairs, texts, texts, self.least).dropDuplicates(["a", "b"]), "links")

    def pairs(self) -> DataFrame:
        """(obj_a, obj_b), obj_a < obj_b: all rows of different documents whose likeness reaches the threshold."""
        docs = self.rows.select("id", "doc").join(self.members, "id").distinct()
        copies = self.members.groupBy("text_hash").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
        docs = written(docs.join(copies, "text_hash"), "members").select("leader", "id", "doc", "n")
        links = self.links().select("a", "b").union(docs.where("n > 1").select(F.col("leader").alias("a"), F.col("leader").alias("b")).distinct())
        a = docs.select(F.col("leader").alias("a"), F.col("id").alias("ia"), F.col("doc").alias("da"))
        b = docs.select(F.col("leader").alias("b"), F.col("id").alias("ib"), F.col("doc").alias("db"))
        both = links.join(a, "a").join(b, "b").where((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))).where(~F.col("da").eqNullSafe(F.col("db")))
        return both.select(F.least("ia", "ib").alias("obj_a"), F.greatest("ia", "ib").alias("obj_b")).where("obj_a < obj_b").distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, links): each member with its class (least id) and the number of texts its own text links to."""
        links = self.links()
        copies = self.members.groupBy("text_hash").agg(F.min("id").alias("leader"))
        ends = links.select(F.col("a").alias("leader")).union(links.select("b")).groupBy("leader").agg(F.count(F.lit(1)).alias("links"))
        classes = components(links).withColumnRenamed("id", "leader")
        out = self.members.join(copies, "text_hash").join(classes, "leader", "left").join(ends, "leader", "left")
        return out.select("id", F.coalesce("class_id", "leader").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
