"""Splits and samples of nodes and edges, in the order of a portable draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import draw
from . import structure


def edge_key() -> Column:
    return F.col("u") * 2000003 + F.col("v")


def first_by_draw(rows: DataFrame, key: Column, stream: int, k: int) -> DataFrame:
    """The k rows of least draw; ties by the key."""
    return rows.withColumn("__d", draw(key, stream)).withColumn("__k", key).orderBy("__d", "__k").limit(k).drop("__d", "__k")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("u")), "u", "left_semi").join(nodes.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


def node_split(edges: DataFrame, ratio: float, total: int, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two node sets without a common node: the first ratio * total by draw, and the rest of total."""
    nodes = structure.vertices(edges)
    if nodes.count() < total:
        raise ValueError("the graph has too few nodes")
    chosen = first_by_draw(nodes, F.col("id"), seed, total)
    first = first_by_draw(nodes, F.col("id"), seed, int(total * ratio))
    return first, chosen.join(first, "id", "left_anti")


def renumbered(edges: DataFrame, nodes: DataFrame, start: int = 0) -> DataFrame:
    """The induced graph with ids start, start + 1, ... in order of the old ids."""
    idx = structure.ranked(nodes.select("id"), "id", start)
    e = induced(edges, nodes)
    return e.join(idx.select(F.col("id").alias("u"), F.col("idx").alias("a")), "u").join(idx.select(F.col("id").alias("v"), F.col("idx").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))


def training_edges(edges: DataFrame, u: int, v: int, present: bool, share: float = 0.7, seed: int = 9) -> DataFrame:
    """A sampled graph that keeps both ends of a target edge and the edge itself only if present."""
    nodes = structure.vertices(edges)
    k = max(5, int(nodes.count() * share))
    kept = first_by_draw(nodes.where(~F.col("id").isin(u, v)), F.col("id"), seed, k).unionByName(nodes.where(F.col("id").isin(u, v)))
    out = induced(edges, kept)
    return out if present else out.where(~((F.col("u") == min(u, v)) & (F.col("v") == max(u, v))))
