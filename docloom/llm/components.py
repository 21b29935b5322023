"""Connected components of a link table, by distributed rounds of least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import written


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of every id in ``links`` (a, b); class_id is the least id of the component.

    Rounds grow with the logarithm of a component's diameter; every round is written to the shared folder.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.least("label", "near").alias("low"), "label")
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = written(low.join(jump, "low").select("id", F.least("low", "far").alias("label"), F.col("label").alias("was")), "labels")
        if new.where("label <> was").isEmpty():
            return new.select("id", F.col("label").alias("class_id"))
        labels = new.select("id", "label")
