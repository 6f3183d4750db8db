"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all ends of ``links`` (a, b): the least node of the component.

    A round gives every node the least label among its neighbours and then the label of that label,
    so paths shorten about by half each round. Each round is written to the shared folder. Hubs are
    joined by the adaptive skew join and combined before the shuffle.
    """
    edges = stage(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "cc-edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "cc-lower")
        if not lower.filter("moved").limit(1).count():
            return lower.select("node", "label")
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = stage(lower.select("node", "label").join(of_label, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after ``links`` (a, b) join components of ``labels`` (node, label); nodes that are
    in neither have no row. Only links between different components are followed."""
    named = labels.withColumnRenamed("label", "_l")
    ends = links.join(named.withColumnRenamed("node", "a"), "a", "left").withColumn("la", F.coalesce("_l", "a")).drop("_l")
    ends = ends.join(named.withColumnRenamed("node", "b"), "b", "left").withColumn("lb", F.coalesce("_l", "b")).drop("_l")
    ends = stage(ends, "cc-ends")
    to = components(ends.filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("label", "_to")
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("e")).select("e.*")
    return labels.unionByName(fresh).distinct().join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
