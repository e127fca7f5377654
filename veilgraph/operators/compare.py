"""Discrepancies between two graphs, two histograms or two partitions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relative_error
from ..session import cut_lineage
from . import structure

EPS = 2.220446049250313e-16


def both_histograms(a: DataFrame, b: DataFrame, key: str = "deg", cnt: str = "cnt") -> DataFrame:
    rows = a.select(F.col(key).alias("k"), F.col(cnt).alias("a"), F.lit(0).cast("long").alias("b")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).cast("long").alias("a"), F.col(cnt).alias("b")))
    return rows.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks(a: DataFrame, b: DataFrame, key: str = "deg", cnt: str = "cnt") -> DataFrame:
    """Two-sample statistic over histograms (as many rows as distinct values); 1 if a side is empty."""
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    h = both_histograms(a, b, key, cnt)
    h = h.select(F.try_divide(F.sum("a").over(upto), F.sum("a").over(total)).alias("fa"), F.try_divide(F.sum("b").over(upto), F.sum("b").over(total)).alias("fb"))
    return h.agg(F.coalesce(F.max(F.abs(F.col("fa") - F.col("fb"))), F.lit(1.0)).alias("ks"))


def kl(a: DataFrame, b: DataFrame, key: str = "deg", cnt: str = "cnt") -> DataFrame:
    total = Window.partitionBy()
    h = both_histograms(a, b, key, cnt).select((F.col("a") / F.sum("a").over(total)).alias("p"), (F.col("b") / F.sum("b").over(total)).alias("q"))
    return h.agg(F.coalesce(F.sum(F.col("p") * F.ln((F.col("p") + EPS) / (F.col("q") + EPS))), F.lit(0.0)).alias("kl"))


def nmi(labels: DataFrame, x: str, y: str) -> DataFrame:
    """Normalised (arithmetic mean) mutual information of two label columns; 1 where both have one class."""
    joint = labels.groupBy(x, y).agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy())
    rows = joint.withColumn("p", F.col("n") / n).withColumn("px", F.sum("p").over(Window.partitionBy(x))).withColumn("py", F.sum("p").over(Window.partitionBy(y)))
    m = rows.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), (-F.sum(F.col("p") * F.ln("px"))).alias("hx"), (-F.sum(F.col("p") * F.ln("py"))).alias("hy"))
    return m.select(F.coalesce(F.try_divide("mi", (F.col("hx") + F.col("hy")) / 2), F.lit(1.0)).alias("nmi"))


def scalar_metrics(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """metric, value: one long table; nodes: as community.node_measures gives them, if they are known."""
    d, t = F.col("deg"), F.col("triangles")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    # one table of the nodes, with their triangles, gives all but one
    mixing = structure.assortativity(edges) if nodes is None else structure.assortativity_of(nodes)
    base = (structure.node_base(edges) if nodes is None else nodes).agg(
        zero(F.count("*")).alias("node_count"), zero(F.sum(d) / 2).alias("edge_count"), zero(F.sum(t) / 3).alias("triangle_count"), zero(F.avg(d)).alias("avg_degree"), zero(F.var_pop(d)).alias("degree_variance"),
        zero(F.try_divide(F.sum(t), F.sum(d * (d - 1) / 2))).alias("global_clustering"), zero(F.avg("clustering")).alias("avg_clustering"))
    names = base.columns
    rows = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("x")).select("x.metric", "x.value")
    return rows.unionByName(mixing.select(F.lit("assortativity").alias("metric"), F.coalesce("assortativity", F.lit(0.0)).alias("value")))


def utility_losses(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """metric, original, synthetic, loss."""
    a, b = scalar_metrics(original).withColumnRenamed("value", "original"), scalar_metrics(synthetic).withColumnRenamed("value", "synthetic")
    return a.join(b, "metric").select("metric", "original", "synthetic", relative_error(F.col("original"), F.col("synthetic")).alias("loss"))


#: The tasks of a full utility report.
TASKS = ("node_count", "edge_count", "triangle_count", "avg_degree", "diameter", "avg_shortest_path", "global_clustering", "avg_clustering", "modularity", "assortativity", "degree_variance", "degree_distribution", "distance_distribution", "community_detection", "eigenvector_centrality")


@dataclass(frozen=True)
class Measures:
    """What is measured of one graph, once: a metric table, two histograms, communities and centralities."""

    scalars: DataFrame
    degrees: DataFrame
    distances: DataFrame
    communities: DataFrame
    centrality: DataFrame


def measured(edges: DataFrame) -> Measures:
    from . import community, paths

    e, nodes = cut_lineage(edges.select("u", "v")), None
    if e.count() <= community.ROUNDS_EDGES:  # held once for all
        graph = paths.held(e)
        distances = cut_lineage(paths.distance_histogram(e, largest=True, graph=graph))
        nodes = cut_lineage(community.node_measures(e, graph))
        labels, centrality = nodes.select("id", "com"), nodes.select("id", "value")
        graph.destroy()
    else:
        distances = cut_lineage(paths.distance_histogram(e, largest=True))
        labels, centrality = cut_lineage(community.louvain(e)), cut_lineage(community.eigenvector_centrality(e).withColumnRenamed("centrality", "value"))
    summary = distances.agg(F.coalesce(F.max("d"), F.lit(0)).cast("double").alias("diameter"), F.coalesce(F.sum(F.col("d") * F.col("cnt")) / F.sum("cnt"), F.lit(0.0)).alias("avg_shortest_path"))
    modularity = (community.modularity(e, labels) if nodes is None else community.modularity_of(nodes)).select(F.lit("modularity").alias("metric"), F.coalesce("modularity", F.lit(0.0)).alias("value"))
    more = [summary.select(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("diameter", "avg_shortest_path")]
    scalars = cut_lineage(reduce(DataFrame.unionByName, [scalar_metrics(e, nodes), *more, modularity]))
    degrees = structure.degree_histogram(e) if nodes is None else nodes.groupBy("deg").agg(F.count("*").alias("cnt"))
    return Measures(scalars, cut_lineage(degrees), distances, labels, centrality)


def community_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - NMI of two partitions (id, com), matched in order of the ids as far as both go; (loss)."""
    from . import influence

    pairs = influence.by_position(a.withColumnRenamed("com", "value"), b.withColumnRenamed("com", "value"))
    return nmi(pairs, "a", "b").select((1 - F.col("nmi")).alias("loss"))


def centrality_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference of two (id, value), matched in order of the ids, against the largest value; (loss)."""
    from . import influence

    return influence.positional_errors(influence.by_position(a, b)).select(F.col("discrepancy").alias("loss"))


def all_losses(real: Measures, fake: Measures) -> DataFrame:
    """metric, loss: the 15 tasks."""
    a, b = real.scalars.withColumnRenamed("value", "original"), fake.scalars.withColumnRenamed("value", "synthetic")
    scalars = a.join(b, "metric").select("metric", relative_error(F.col("original"), F.col("synthetic")).alias("loss"))
    named = lambda name, df, c: df.select(F.lit(name).alias("metric"), F.col(c).alias("loss"))
    return reduce(DataFrame.unionByName, [scalars, named("degree_distribution", ks(real.degrees, fake.degrees), "ks"), named("distance_distribution", ks(real.distances, fake.distances, "d"), "ks"),
                                          named("community_detection", community_loss(real.communities, fake.communities), "loss"), named("eigenvector_centrality", centrality_loss(real.centrality, fake.centrality), "loss")])


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the k highest (id, value) of a among those of b."""
    first = lambda t: t.orderBy(F.desc("value"), "id").limit(k).select("id")
    return first(a).join(first(b), "id", "left_semi").agg((F.count("*") / F.lit(float(k))).alias("overlap"))
