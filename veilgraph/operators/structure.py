"""Structure of a graph: degrees, triangles, clustering, features of nodes and edges.

Edges are (u, v) with u < v, distinct; vertices are (id). Triangles close over edges oriented from the end of lower
degree to the end of higher degree, so a hub never meets itself: the join makes O(m ** 1.5) rows at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.src", "e.dst")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, deg); with nodes, isolated ones have 0."""
    deg = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    return deg if nodes is None else nodes.join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def graph_size(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.count("*").alias("node_count"), F.coalesce(F.sum("deg") / 2, F.lit(0)).cast("long").alias("edge_count"))


def degree_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    d = F.col("deg")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return degrees(edges, nodes).agg(
        F.count("*").alias("node_count"), zero(F.avg(d)).alias("avg_degree"), zero(F.var_pop(d)).alias("degree_variance"), zero(F.var_samp(d)).alias("degree_variance_sample"),
        zero(F.stddev_pop(d)).alias("degree_std"), F.coalesce(F.max(d), F.lit(0)).alias("max_degree"), F.coalesce(F.min(d), F.lit(0)).alias("min_degree"))


def degree_histogram(edges: DataFrame, dense: bool = False) -> DataFrame:
    h = degrees(edges).groupBy("deg").agg(F.count("*").alias("cnt"))
    if not dense:
        return h
    grid = h.agg(F.max("deg").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("deg"))
    return grid.join(h, "deg", "left").select("deg", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def relabelled(edges: DataFrame, start: int = 0) -> DataFrame:
    """(id, idx): rank of the id, from start; ranks come from range partitions, not from one task."""
    return ranked(vertices(edges), "id", start)


def ranked(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """Adds idx, the 0-based rank by a column of distinct values, plus start. Sorted runs are numbered in parallel: the
    number of rows in the runs before (one row a run) is added to the rank within the run."""
    from ..session import cut_lineage

    runs = df.repartitionByRange(column).withColumn("run", F.spark_partition_id())
    runs = cut_lineage(runs)
    before = runs.groupBy("run").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("run", "before")
    within = F.row_number().over(Window.partitionBy("run").orderBy(column))
    return runs.withColumn("n", within).join(F.broadcast(before), "run").withColumn("idx", (F.col("before") + F.col("n") - 1 + start).cast("long")).drop("run", "n", "before")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each triangle once."""
    deg = degrees(edges)
    both = edges.join(deg.select(F.col("id").alias("u"), F.col("deg").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("deg").alias("dv")), "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    out = both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("t"))
    one, two = out.select(F.col("s").alias("a"), F.col("t").alias("b")), out.select(F.col("s").alias("a"), F.col("t").alias("c"))
    wedges = one.join(two, "a").where("b < c")
    return wedges.join(edges.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangles_per_node(edges: DataFrame) -> DataFrame:
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return vertices(edges).join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def node_base(edges: DataFrame) -> DataFrame:
    """(id, deg, triangles, clustering): clustering is also the connection ratio of a node's neighbours."""
    d, t = F.col("deg"), F.col("triangles")
    return degrees(edges).join(triangles_per_node(edges), "id").select("id", "deg", "triangles", F.when(d < 2, 0.0).otherwise(2.0 * t / F.nullif(d * (d - 1), F.lit(0))).alias("clustering"))


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count("*").alias("triangle_count"))


def clustering_summary(edges: DataFrame) -> DataFrame:
    d = F.col("deg")
    return node_base(edges).agg(
        F.coalesce(F.try_divide(F.sum("triangles"), F.sum(d * (d - 1) / 2)), F.lit(0.0)).alias("transitivity"), F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of degrees over both directions of each edge; null where a variance is 0."""
    deg = degrees(edges)
    x = symmetric(edges).join(deg.select(F.col("id").alias("src"), F.col("deg").cast("double").alias("x")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").cast("double").alias("y")), "dst")
    m = x.agg(F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return m.select(F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.sqrt("vx") * F.sqrt("vy")).alias("assortativity"))


def assortativity_of(nodes: DataFrame) -> DataFrame:
    """assortativity, of nodes (deg, near): near is the sum of the neighbours' degrees."""
    d, total = F.col("deg").cast("double"), F.sum("deg")
    mean = nodes.agg((F.sum(d * d) / total).alias("mx"))
    m = nodes.crossJoin(F.broadcast(mean)).agg((F.sum(d * F.col("near")) / total).alias("xy"), F.first("mx").alias("mx"), (F.sum(d * (d - F.col("mx")) * (d - F.col("mx"))) / total).alias("v"))
    return m.select(F.try_divide(F.col("xy") - F.col("mx") * F.col("mx"), F.col("v")).alias("assortativity"))


def neighbor_stats(edges: DataFrame) -> DataFrame:
    deg = degrees(edges)
    d = F.col("deg")
    return symmetric(edges).join(deg, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("node")).agg(
        F.avg(d).alias("neighbor_avg_degree"), F.stddev_pop(d).alias("neighbor_degree_std"), F.max(d).alias("neighbor_max_degree"), F.min(d).alias("neighbor_min_degree")).withColumnRenamed("node", "id")


def local_density(edges: DataFrame) -> DataFrame:
    d = F.col("deg")
    return node_base(edges).select("id", F.when(d < 1, 0.0).otherwise((d + F.col("triangles")) / (d * (d + 1) / 2)).alias("local_density"))


def second_neighbors(edges: DataFrame) -> DataFrame:
    """Distinct ends of two-step paths but the node itself."""
    s = symmetric(edges)
    two = s.select(F.col("src").alias("id"), F.col("dst").alias("mid")).join(s.select(F.col("src").alias("mid"), "dst"), "mid").where("dst <> id").select("id", "dst").distinct()
    return vertices(edges).join(two.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("second_neighbor_count"))


def two_hop_features(edges: DataFrame) -> DataFrame:
    """Density among, and mean degree of, the nodes within two steps (the node itself left out). A node's neighbourhood is met
    in one task and never written where tasks can hold the graph."""
    from ..session import cut_lineage
    from . import paths

    edges = cut_lineage(edges.select("u", "v"))
    if edges.count() > paths.BROADCAST_EDGES:
        return _joined_two_hop_features(edges)
    graph = paths.held(edges)

    def run(batches):
        own = paths.Adjacency(*graph.value)
        here = np.zeros(len(own.ids), bool)
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                one = own.to[own.at[i] : own.at[i + 1]]
                near = np.unique(np.concatenate([one, own.to[own.reach(one)[0]]]))
                near = near[near != i]
                here[near] = True
                inside, deg = int(np.count_nonzero(here[own.to[own.reach(near)[0]]])) // 2, own.deg[near]
                k = len(near)
                rows.append((own.ids[i], k, 2.0 * inside / (k * (k - 1)) if k > 1 else 0.0, deg.mean(), deg.std()))
                here[near] = False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["id", "two_hop_nodes", "two_hop_density", "two_hop_mean_degree", "two_hop_degree_std"])

    return paths.spread_range(edges.sparkSession, len(graph.value[0])).mapInArrow(run, "id long, two_hop_nodes long, two_hop_density double, two_hop_mean_degree double, two_hop_degree_std double")


def _joined_two_hop_features(edges: DataFrame) -> DataFrame:
    s = symmetric(edges)
    hop = s.select(F.col("src").alias("id"), F.col("dst").alias("w"))
    two = hop.join(s.select(F.col("src").alias("w"), F.col("dst").alias("x")), "w").select("id", F.col("x").alias("w"))
    near = hop.unionByName(two).where("w <> id").distinct()
    size = near.join(degrees(edges).withColumnRenamed("id", "w"), "w").groupBy("id").agg(F.count("*").alias("k"), F.avg("deg").alias("mean_degree"), F.stddev_pop("deg").alias("degree_std"))
    inside = near.join(edges.withColumnRenamed("u", "w"), "w").join(near.select("id", F.col("w").alias("v")), ["id", "v"]).groupBy("id").agg(F.count("*").alias("m"))
    k = F.col("k")
    return size.join(inside, "id", "left").select("id", k.alias("two_hop_nodes"), F.coalesce(F.try_divide(2.0 * F.coalesce("m", F.lit(0)), k * (k - 1)), F.lit(0.0)).alias("two_hop_density"), F.col("mean_degree").alias("two_hop_mean_degree"), F.col("degree_std").alias("two_hop_degree_std"))


def edge_features(edges: DataFrame) -> DataFrame:
    """Common neighbours, Jaccard, degree product and difference, triangles and mean clustering of both ends."""
    s = symmetric(edges)
    common = edges.join(s.select(F.col("src").alias("u"), F.col("dst").alias("w")), "u").join(s.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"]).groupBy("u", "v").agg(F.count("*").alias("c"))
    base = node_base(edges)
    a, b = (base.select(F.col("id").alias(k), F.col("deg").alias(f"d{k}"), F.col("triangles").alias(f"t{k}"), F.col("clustering").alias(f"c{k}")) for k in "uv")
    c = F.coalesce("c", F.lit(0))
    return edges.join(common, ["u", "v"], "left").join(a, "u").join(b, "v").select(
        "u", "v", c.alias("common_neighbors"), (c / (F.col("du") + F.col("dv") - c)).alias("jaccard"), (F.col("du") * F.col("dv")).alias("preferential_attachment"),
        F.abs(F.col("du") - F.col("dv")).alias("degree_difference"), (F.col("tu") + F.col("tv")).alias("end_triangles"), ((F.col("cu") + F.col("cv")) / 2).alias("mean_clustering"))


def node_features(edges: DataFrame) -> DataFrame:
    """One table of the attributes of nodes, computed for all nodes at once."""
    return node_base(edges).withColumnRenamed("clustering", "neighbor_connection_ratio").join(local_density(edges), "id").join(neighbor_stats(edges), "id").join(second_neighbors(edges), "id")


def padded_nodes(edges: DataFrame, n: int) -> DataFrame:
    """(id): the nodes of the graph and 0 to n - 1, isolated or not."""
    return vertices(edges).unionByName(edges.sparkSession.range(n).select("id")).distinct()


def positive_cells(cells: DataFrame) -> DataFrame:
    """cells: (i, j, x) of a matrix. (u, v): pairs with a positive cell above or below the diagonal."""
    return canonical(cells.where("x > 0").select(F.col("i").alias("u"), F.col("j").alias("v")))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): repeated h-index of the neighbours' values, which falls to the core number; until nothing moves."""
    from ..session import cut_lineage

    s = cut_lineage(symmetric(edges))
    value = degrees(edges).withColumnRenamed("deg", "core")
    while True:
        near = s.join(value.withColumnRenamed("id", "dst"), "dst").groupBy("src", "core").count()
        at_least = F.sum("count").over(Window.partitionBy("src").orderBy(F.desc("core")))
        h = near.withColumn("n", at_least).groupBy(F.col("src").alias("id")).agg(F.max(F.least("core", "n")).alias("h"))
        new = cut_lineage(value.join(h, "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")))
        value = new.select("id", "core")
        if new.where("moved").isEmpty():
            return value
