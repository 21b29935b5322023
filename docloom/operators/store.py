"""The chunk store: knowledge bases as partitions of parquet tables, with filters, paging, replacement and deletion.

A knowledge base ``Kb_<id>`` is the partition ``kb_id=<id>`` of the store's table; it can be looked up, described and
dropped by itself. Rows of one document are written together, so replacing a document rewrites only the files that hold it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.runtime import drop_path, names_in, written

QUERYABLE = ("text", "table_full", "table_row")
# The stored properties, with the default of a missing one.
PROPERTIES = {
    "doc_id": "", "chunk_id": "", "chunk_type": "", "content": "", "description": "", "keywords": "", "parent_id": "", "sheet": "", "table_id": "",
    "row_no": 0, "header": "", "paragraph_index": 0, "original_filename": "", "image_type": "", "context_relation": "", "key_information": "",
}
# Names of types that a collection's properties may be declared with.
_TYPES = {
    "text": T.StringType(), "string": T.StringType(), "uuid": T.StringType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "number": T.DoubleType(),
    "float": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "text_array": T.ArrayType(T.StringType()),
    "vector": T.ArrayType(T.FloatType()),
}


def data_type(name: str) -> T.DataType:
    """The Spark type of a declared property type; an unknown name is an error rather than text."""
    try:
        return _TYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown property type {name!r}") from None


@dataclass(frozen=True)
class Equal:
    path: str
    value: object


@dataclass(frozen=True)
class ContainsAny:
    path: str
    values: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


def predicate(f: Equal | ContainsAny | And) -> Column:
    """A filter as a column: pushed down to the scan; null never matches."""
    if isinstance(f, And):
        return reduce(lambda a, b: a & b, map(predicate, f.parts), F.lit(True))
    return F.col(f.path) == F.lit(f.value) if isinstance(f, Equal) else F.col(f.path).isin(*f.values)


def chunk_types(asked: str | list[str] | None) -> list[str]:
    """The queryable types asked for, one name or a list of them; unknown ones fall out."""
    return [t for t in ([asked] if isinstance(asked, str) else asked or []) if t in QUERYABLE]


def kb_view(chunks: DataFrame) -> DataFrame:
    """The stored properties of a chunk, missing ones at their default, and image_path: an image's content."""
    cols = [F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in PROPERTIES.items()]
    image = F.when(F.col("chunk_type") == "image", F.coalesce("content", F.lit(""))).otherwise("").alias("image_path")
    return chunks.select("obj_id", "kb_id", *cols, image)


def join_values(c) -> Column:
    return F.array_join(c, ", ")


def split_values(c) -> Column:
    """Values between commas, stripped; an empty or null text has none. Values that hold a comma don't survive."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ","), lambda v: F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def latest(chunks: DataFrame, by: str = "stored_at") -> DataFrame:
    """One row per (kb_id, chunk_id): the one stored last, then the one of the greatest obj_id. Copies are thinned out before the shuffle."""
    best = F.max_by(F.struct(*[F.col(c) for c in chunks.columns]), F.struct(by, "obj_id")).alias("__docloom_best")
    kept = chunks.groupBy(F.col("kb_id").alias("__docloom_kb"), F.col("chunk_id").alias("__docloom_id")).agg(best)
    return kept.select("__docloom_best.*")


def upsert(base: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("kb_id", "doc_id")) -> DataFrame:
    """``base`` with all rows of the batch's documents replaced by the batch's; doing it again changes nothing. Null keys are
    keys too: they equal each other."""
    return without(base, batch, keys).unionByName(batch)


def without(base: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("kb_id", "doc_id")) -> DataFrame:
    """``base`` without the batch's documents."""
    new = batch.select(*[F.col(k).alias(f"__docloom_{k}") for k in keys]).distinct()
    return base.join(new, [F.col(k).eqNullSafe(F.col(f"__docloom_{k}")) for k in keys], "left_anti")


def delete_by_filter(base: DataFrame, f) -> DataFrame:
    """The rows that stay: all for which the filter isn't true, nulls included."""
    return base.where(~F.coalesce(predicate(f), F.lit(False)))


def filter_query(base: DataFrame, f, limit: int = 100, offset: int = 0) -> DataFrame:
    """The first ``limit`` matches after ``offset`` in order of chunk_id, then obj_id."""
    return base.where(predicate(f)).orderBy("chunk_id", "obj_id").offset(offset).limit(limit)


def page(base: DataFrame, after, limit: int, key: str = "obj_id") -> DataFrame:
    """One page in order of ``key``, past ``after`` (null for the first), with the cursor of the next, null on the last page."""
    rows = base if after is None else base.where(F.col(key) > after)
    rows = rows.orderBy(key).limit(limit)
    full = rows.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")).select(F.when(F.col("n") == limit, F.col("top")).alias("next_cursor"))
    return rows.join(F.broadcast(full))  # one row


def collection_counts(base: DataFrame) -> DataFrame:
    return base.groupBy("kb_id").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("chunk_id").alias("chunks"))


def checked_batch(rows: DataFrame) -> DataFrame:
    """Rows with ok: those that can be stored (a knowledge base, a document, a chunk id and a queryable or image type)."""
    known = F.col("chunk_type").isin(*QUERYABLE, "image")
    ok = F.col("kb_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull() & F.coalesce(known, F.lit(False))
    return rows.withColumn("ok", ok)


class Store:
    """Collections under one root folder; every collection is a parquet table partitioned by kb_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"bad collection name {name!r}")
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _base(self, name: str, kb_id: int | None) -> str:
        return self._path(name) if kb_id is None else f"{self._path(name)}/kb_id={int(kb_id)}"

    def exists(self, name: str, kb_id: int | None = None) -> bool:
        """Whether there is the collection, or the knowledge base in it."""
        fs, p = self._fs(self._base(name, kb_id))
        return bool(fs.exists(p))

    def create(self, name: str, properties: dict[str, str]) -> bool:
        """True if the collection is there afterwards; an existing one stays as it is."""
        if not self.exists(name):
            schema = T.StructType([T.StructField("kb_id", T.IntegerType()), *[T.StructField(k, data_type(v)) for k, v in properties.items()]])
            self.spark.createDataFrame([], schema).write.parquet(self._path(name))
        return True

    def drop(self, name: str, kb_id: int | None = None) -> bool:
        """Drop a collection, or one knowledge base of it; false if there was no such one."""
        if not self.exists(name, kb_id):
            return False
        drop_path(self.spark, self._base(name, kb_id))
        return True

    def bases(self, name: str) -> list[int]:
        """The knowledge bases of a collection."""
        found = [re.fullmatch(r"kb_id=(\d+)", n) for n in names_in(self.spark, self._path(name))]
        return sorted(int(m[1]) for m in found if m)

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str, kb_id: int | None = None) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"collection {name} does not exist")
        rows = self.spark.read.parquet(self._path(name))
        return rows if kb_id is None else rows.where(F.col("kb_id") == kb_id)

    def info(self, name: str, kb_id: int | None = None) -> DataFrame:
        """(property, type, objects) of a collection, or of one knowledge base."""
        df = self.read(name, kb_id)
        fields = self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "property string, type string")
        return fields.withColumn("objects", F.lit(df.count()))

    def insert(self, name: str, rows: DataFrame) -> None:
        if not self.exists(name):
            raise ValueError(f"collection {name} does not exist")
        self._append(name, rows)

    def _append(self, name: str, rows: DataFrame) -> None:
        """Rows of a document into one file; the engine splits a document that is too large for it."""
        rows.hint("rebalance", "kb_id", "doc_id").write.mode("append").partitionBy("kb_id").parquet(self._path(name))

    def delete(self, name: str, f: Equal | ContainsAny | And) -> None:
        """Delete the rows that a filter matches; files without one stay as they are."""
        hit = self.read(name).where(F.coalesce(predicate(f), F.lit(False)))
        self._rewrite(name, self._files(hit), lambda old: delete_by_filter(old, f))

    def replace_documents(self, name: str, batch: DataFrame) -> None:
        """Replace the documents of the batch; only the files that hold rows of them are rewritten.

        The new files are written before the old ones are deleted; after a crash in between, the same call again puts it right.
        """
        batch = written(batch, "upsert-batch")
        new = batch.select("kb_id", "doc_id").distinct()
        old = self.read(name)
        hit = old.join(new.withColumnsRenamed({"kb_id": "_k", "doc_id": "_d"}), F.col("kb_id").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
        self._rewrite(name, self._files(hit), lambda old: without(old, batch), batch)
        for folder in {f.rpartition("/")[0] for f in batch.inputFiles()}:
            drop_path(self.spark, unquote(folder))

    def _files(self, hit: DataFrame) -> list[str]:
        """The files that rows come from: names, as many as there are files."""
        return [unquote(r[0]) for r in hit.select(F.col("_metadata.file_path")).distinct().collect()]

    def _rewrite(self, name: str, paths: list[str], kept, more: DataFrame | None = None) -> None:
        rows = more
        if paths:
            old = self.spark.read.option("basePath", self._path(name)).parquet(*paths)
            stay = kept(old)
            rows = stay if rows is None else stay.select(*rows.columns).unionByName(rows)
        if rows is not None:
            self._append(name, rows)
        for p in paths:
            drop_path(self.spark, p)
