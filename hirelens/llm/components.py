"""Connected components of a graph given as an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (v, root): the smallest vertex each vertex can reach.

    Every round takes the smallest label among a vertex's neighbours and then the label's
    own label, so labels travel at doubling distances; each round's labels are
    written as a table. A vertex with very many edges only meets partial minima.
    Vertices without edges do not appear.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = materialize(labels, "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near")))
        hooked = labels.join(near, "v").select("v", F.least("root", "near").alias("up"), F.col("root").alias("old"))
        jump = labels.select(F.col("v").alias("up"), F.col("root").alias("top"))
        step = hooked.join(jump, "up", "left").select("v", F.least("up", F.coalesce("top", "up")).alias("root"), "old")
        step = materialize(step, "labels")
        if not step.where("root <> old").take(1):
            return step.select("v", "root")
        labels = step.select("v", "root")
