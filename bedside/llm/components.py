"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bedside.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (u, v); the label is the smallest
    node of its component.

    Each round points every node at its smallest neighbour, jumps twice along
    the pointers and contracts the graph, so rounds are logarithmic in the
    length of a chain. A node with very many edges is met by a partial
    aggregate or as the unsplit side of a join, never gathered.
    """
    here = cut(edges.filter("u != v").select("u", "v"), "edges")
    labels: DataFrame | None = None
    while not here.isEmpty():
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = cut(both.groupBy("u").agg(F.min("v").alias("p")).withColumn("p", F.least("u", "p")), "points")
        for _ in range(2):
            far = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            points = points.join(far, "p").select("u", F.col("q").alias("p"))
        points = cut(points, "points")
        if labels is None:
            labels = points.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            step = points.withColumnRenamed("u", "label")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = cut(labels, "labels")
        left = here.join(points, "u").select(F.col("p").alias("a"), "v")
        right = points.select(F.col("u").alias("v"), F.col("p").alias("b"))
        here = left.join(right, "v").filter("a != b")
        here = cut(here.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if labels is None:
        return here.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
