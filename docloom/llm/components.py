"""Connected components of a link table, by repeated hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, scratch


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, label) for every node of ``links`` (a, b), with the smallest node as label; and the tables to drop later.

    Each round hooks every node to its smallest smaller neighbour and halves the pointers' paths until
    all point at roots; links are then carried over to roots and those within a root vanish. Every
    step is a join on a node and is written to the shared folder. The links are never collected.
    """
    spark = links.sparkSession
    made: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch(spark, name))
        return save(df, made[-1])

    links = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = kept(nodes.withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        # each larger end hooks to its smallest neighbour: a forest, as labels fall along it
        parents = kept(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "parents")
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = kept(parents.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents")
            parents = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        roots = parents.select(F.col("node").alias("label"), "up")
        labels = kept(labels.join(roots, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        a = links.join(parents.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a", "left")
        ab = a.join(parents.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
        links = kept(ab.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels, made

