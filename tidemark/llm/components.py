"""Connected components of a graph of ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each end of an edge can reach.

    ``edges`` has columns ``a`` and ``b``.  Each round sends labels over the edges, then replaces a
    label by its own label, and ends in a written table; the number of rounds grows with the
    logarithm of the longest path for the most part.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id"))
        met = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        roots = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        new = materialize(met.join(roots, "low", "left").select(
            "id", F.least("low", F.coalesce("jump", "low")).alias("component"),
            (F.least("low", F.coalesce("jump", "low")) < F.col("component")).alias("moved")), "labels")
        labels = new.select("id", "component")
        if new.filter("moved").isEmpty():
            return labels
