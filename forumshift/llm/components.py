"""Connected components of an edge table by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(v, label)``: the smallest vertex reachable from each vertex
    that has an edge.

    Every round each vertex takes the smallest label among its neighbours' and then the
    label of that label, so chains shrink geometrically; labels are written to the shared
    folder after each round and never leave Spark (only the number of changes does).
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("v"))
                     .agg(F.least(F.col("v"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near")))
        hooked = (labels.join(near, "v")
                  .select("v", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        to = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = written(hooked.join(to, "label", "left")
                      .select("v", "was", F.least("label", F.coalesce("further", "label")).alias("label")),
                      "cc-labels")
        labels = new.select("v", "label")
        if new.filter("was <> label").isEmpty():
            return labels
