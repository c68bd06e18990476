"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.tables import by_shuffle, kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Points every larger neighbour of a node at the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("near"))
    return (
        both.join(by_shuffle(least), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "near").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Points a node and its smaller neighbours at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("near"))
    moved = edges.join(by_shuffle(least), "u").where("v != near").select(F.col("v").alias("u"), F.col("near").alias("v"))
    return moved.unionByName(least.select("u", F.col("near").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has that one edge only, so that no round would change anything. One grouping, added up by map tasks."""
    ends = edges.selectExpr("stack(2, u, 1, v, 0) AS (node, larger)")
    nodes = ends.groupBy("node").agg(F.count("*").alias("edges"), F.sum("larger").alias("larger"))
    return not nodes.agg(F.expr("count_if(larger > 0 AND edges > 1)")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, for every node of ``links`` (``a``, ``b``).

    Alternates large and small stars until the edges are stars, which takes a number of rounds
    that grows with the logarithm of the number of nodes. Only joins and minima are used, so a node with
    many neighbours is split like any skewed join key, and every round is written to shared storage. Rows with
    a null or two equal ends are ignored; no links give no rows.
    """
    edges = kept(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _are_stars(edges):
        edges = kept(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The :func:`components` ``labels`` after more ``links``; without any, ``labels`` itself."""
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
