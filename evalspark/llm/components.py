"""Connected components of an edge table, each named by its smallest vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every vertex of an edge.

    Every round gives a vertex the smallest label among itself and its neighbours and then
    follows the label's own label, so chains shrink by half. Labels are written to the shared
    folder each round. All steps are joins and minima; a vertex with very many edges is a
    join key that the engine splits.
    """
    both = cut_lineage(edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                       .unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))).where("src != dst").distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("src"), F.min("dst")).alias("label")))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.src).select("id", "label", F.least("label", "near").alias("lower"))
        of_label = labels.select(F.col("id").alias("_id"), F.col("label").alias("_root"))
        stepped = cut_lineage(lower.join(of_label, F.col("lower") == F.col("_id"), "left")
                              .select("id", F.col("label").alias("was"), F.least("lower", F.coalesce("_root", "lower")).alias("label")))
        labels = stepped.select("id", "label")
        if stepped.where("was != label").isEmpty():
            return labels.withColumnRenamed("label", "component")
