"""Session helpers: the shared work folder and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A machine-local folder is set only where the session names none and runs on one machine (tests, a laptop); a cluster
    without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; its results must have been used or written by then."""
    drop_path(spark, _own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table by its path (idempotent)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a short text into a new file at once: it is there as a whole or not at all."""
    p, part = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it stands in fewer partitions than there are; a large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running(df: DataFrame, keys: list[str], major: str, minor: list[str], value: Column, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value``, a whole number, over the rows of its key up to this one, in order of the whole number
    ``major``, then ``minor``.

    Rows are summed within stretches of ``width`` values of ``major``, and stretches are counted on by a small table, so
    that a key that holds a third of all rows isn't sorted in one task. A null ``major`` comes first.
    """
    df = df.withColumn("__docloom_s", F.coalesce(F.floor(F.col(major) / width), F.lit(-(1 << 62)))).withColumn("__docloom_v", value)
    sums = df.groupBy(*keys, "__docloom_s").agg(F.sum("__docloom_v").alias("__docloom_c"))
    upto = Window.partitionBy(*keys).orderBy("__docloom_s").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(k).alias(f"__docloom_{k}") for k in keys], F.col("__docloom_s").alias("__docloom_t"), F.coalesce(F.sum("__docloom_c").over(upto), F.lit(0)).alias("__docloom_b"))
    own = F.sum("__docloom_v").over(Window.partitionBy(*keys, "__docloom_s").orderBy(major, *minor).rowsBetween(Window.unboundedPreceding, 0))
    on = [F.col(k).eqNullSafe(F.col(f"__docloom_{k}")) for k in keys] + [F.col("__docloom_s") == F.col("__docloom_t")]
    out = df.withColumn("__docloom_o", own).join(before, on).withColumn(name, (F.col("__docloom_o") + F.col("__docloom_b")).cast("int"))
    return out.drop(*[c for c in out.columns if c.startswith("__docloom_")])


def numbered(df: DataFrame, keys: list[str], major: str, minor: list[str], name: str, width: int = 4096) -> DataFrame:
    """``df`` with a dense number from 1 per key, in order of the whole number ``major``, then ``minor``; see ``running``."""
    return running(df, keys, major, minor, F.lit(1), name, width)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(Path(package.name) / p.relative_to(package)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
