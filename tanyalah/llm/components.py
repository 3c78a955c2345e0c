"""Connected components of a table of edges, by hooking onto the least neighbour and pointer jumping.

Every round at least halves the components that still have edges. What a round
leaves is written to the shared folder, so plans stay short and a lost executor
costs one round at most. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.sources.scratch import fresh_folder


def written(frame: DataFrame, label: str) -> DataFrame:
    """The rows of `frame`, written to the shared folder and read back."""
    folder = fresh_folder(frame.sparkSession, label)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _flat(parents: DataFrame) -> DataFrame:
    """Parents (a, parent) with every parent a root; each parent is below its child, so there are no cycles."""
    while True:
        up = parents.select(F.col("a").alias("parent"), F.col("parent").alias("_up"))
        jumped = parents.join(up, "parent", "left").select("a", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved"))
        jumped = written(jumped, "jump")
        parents = jumped.select("a", "parent")
        if jumped.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """The least node of the component of every node of the edges (a, b): node, component.

    Loops, repeated and reversed edges make no difference; edges with a null are ignored.
    """
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = written(left, "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        parents = _flat(written(left.groupBy("a").agg(F.min("b").alias("parent")), "hook"))
        of = parents.select(F.col("a").alias("component"), "parent")
        labels = written(labels.join(of, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        ends = left
        for end in ("a", "b"):
            ends = ends.join(parents.select(F.col("a").alias(end), F.col("parent").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        left = written(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels
