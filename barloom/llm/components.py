"""Connected components of a table of links, by hooking and pointer jumping over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common


def components(links: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): root is the smallest node of the node's component.

    Rounds of large-star and small-star: each turns a node's links towards its smallest neighbour,
    first for the larger neighbours, then for the smaller ones, until links are stars. All rounds
    are joins and aggregates over links, written to the shared folder. Each join stands between plain
    exchanges, so that Spark can split a hub's rows; a hub's neighbours are never gathered in one place.
    """
    edges = common.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = common.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        least = common.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        turned = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = common.keep(turned.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        # stars: no node is both a larger and a smaller end, and each has one link
        done = new.groupBy("a").count().where("count > 1").isEmpty() and new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        edges = new
        if done:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components of all links, given those (roots) of the links so far and further links
    (a, b). Only roots and the ends of the further links meet."""

    def up(df: DataFrame, end: str) -> DataFrame:
        found = df.join(roots.select(F.col("node").alias(end), F.col("root").alias("__r")), end, "left")
        return found.withColumn(end, F.coalesce("__r", end)).drop("__r")

    again = common.keep(components(up(up(links, "a"), "b").select("a", "b")), "roots")
    old = roots.join(again.select(F.col("node").alias("root"), F.col("root").alias("__n")), "root", "left").select("node", F.coalesce("__n", "root").alias("root"))
    return old.unionByName(again.join(roots.select("node"), "node", "left_anti"))
