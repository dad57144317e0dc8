"""Connected components of an edge list by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import dealt, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(v, label)`` for every vertex of ``edges(u, v)``: the smallest vertex of its component.

    Each round hangs every vertex below its smallest neighbour, jumps twice, and contracts; the
    edges left over at least halve with each round. Vertices without an edge, self loops apart, are
    not returned.
    """
    left = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("u").alias("v"), F.col("v").alias("w")).unionByName(left.select("v", F.col("u").alias("w")))
        parent = both.groupBy("v").agg(F.least("v", F.min("w")).alias("p"))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parent = materialise(parent.join(dealt(up), "p").select("v", F.col("q").alias("p")))
        if labels is None:
            labels = parent.withColumnRenamed("p", "label")
        else:
            step = parent.select(F.col("v").alias("label"), "p")
            labels = labels.join(dealt(step), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        labels = materialise(labels)
        pu = parent.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        pv = parent.select("v", F.col("p").alias("pv"))
        left = materialise(left.join(dealt(pu), "u").join(dealt(pv), "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).filter("u < v").distinct())
    if labels is None:
        return edges.select("v", F.col("v").alias("label")).limit(0)
    return labels
