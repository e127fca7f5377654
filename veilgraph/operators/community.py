"""Partitions: quotient graphs, modularity, a synchronous Louvain pass, power iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gumbel, uniform
from ..functions.noise import draw, drawn
from ..session import cut_lineage
from . import paths, structure

#: Edges up to which many short rounds over a graph are one task's work; beyond, each round is a few joins. A graph is held
#: for that alone, with weights, up to ALONE_EDGES.
ROUNDS_EDGES, ALONE_EDGES = paths.BROADCAST_EDGES, 2_000_000
#: Arcs whose ends move at once.
MOVED_ARCS = 1 << 20


def in_one_task(edges: DataFrame, work, schema: str, *more: str, graph=None) -> DataFrame:
    """The columns that work(adjacency) gives, in one task that holds the graph; graph: as paths.held gives it, if it is held."""
    graph, names = graph or paths.held(edges, *more), [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for _ in batches:
            own = paths.Adjacency(*graph.value)
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(own)], names)

    return edges.sparkSession.range(0, 1, 1, 1).mapInArrow(run, schema)


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (id, com)."""
    return edges.join(labels.select(F.col("id").alias("u"), F.col("com").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("com").alias("cv")), "v")


def quotient_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(c1, c2, weight), c1 <= c2; loops hold the edges inside."""
    return _ends(edges, labels).groupBy(F.least("cu", "cv").alias("c1"), F.greatest("cu", "cv").alias("c2")).agg(F.count("*").alias("weight"))


def inter_group_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node the number of neighbours with another label."""
    e = structure.symmetric(_ends(edges, labels).where("cu <> cv").select("u", "v")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return labels.select("id").join(e, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("inter_edges"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    q = quotient_graph(edges, labels)
    ends = q.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("weight").alias("w"), F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0).alias("i")), F.struct(F.col("c2").alias("c"), F.col("weight").alias("w"), F.lit(0).cast("long").alias("i")))).alias("x")).select("x.*")
    com = ends.groupBy("c").agg(F.sum("w").alias("dg"), F.sum("i").alias("inc"))
    m = q.agg(F.sum("weight").alias("m"))
    share = F.col("dg") / (2 * F.col("m"))
    return com.join(F.broadcast(m), F.lit(True)).agg(F.sum(resolution * F.col("inc") / F.col("m") - share * share).alias("modularity"))


def exponential_moves(edges: DataFrame, labels: DataFrame, epsilon: float, passes: int = 1, seed: int = 11) -> DataFrame:
    """One synchronous DP pass: each node draws among all communities by the exponential mechanism, as an argmax of scaled
    gains with Gumbel noise. A community without a neighbour gains -w(own) like any other of its kind: the communities are as
    many rows a node, so they are to be few (a bounded number of blocks, as the private partitions have)."""
    c1 = epsilon / (4.0 * passes)
    every = labels.select("id").crossJoin(F.broadcast(labels.select("com").distinct())).select("id", "com", F.lit(0).cast("long").alias("w"))
    near = structure.symmetric(edges).join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.count("*").alias("w"))
    near = near.unionByName(every).groupBy("id", "com").agg(F.sum("w").alias("w"))
    own = near.join(labels.withColumnRenamed("com", "mine"), "id").withColumn("at_home", F.sum(F.when(F.col("com") == F.col("mine"), F.col("w")).otherwise(0)).over(_by("id")))
    u = uniform(F.col("id") * 2000003 + F.col("com"), seed)
    rated = own.withColumn("rate", c1 * (F.col("w") - F.col("at_home")) + gumbel(u))
    return rated.groupBy("id").agg(F.max_by("com", F.struct(F.round("rate", 9), "com")).alias("com"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.select("u", "v", F.lit(1).cast("long").alias("weight"))


def weighted_quotient(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v, weight) of the graph of communities, u <= v; a loop holds the weight inside."""
    ends = _ends(weighted(edges), labels)
    return ends.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight"))


def renumbered(labels: DataFrame) -> DataFrame:
    """(id, com): communities numbered from 0 in order of their old names."""
    names = structure.ranked(labels.select(F.col("com").alias("old")).distinct(), "old")
    return labels.select("id", F.col("com").alias("old")).join(names, "old").select("id", F.col("idx").alias("com"))


def community_state(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(com, degree, internal, loops): total degree, weight inside (loops whole, other edges once), weight of loops."""
    e = _ends(weighted(edges), labels)
    ends = e.select(F.explode(F.array(F.struct(F.col("cu").alias("com"), F.lit(1).alias("first")), F.struct(F.col("cv").alias("com"), F.lit(0).alias("first")))).alias("x"), "weight", (F.col("cu") == F.col("cv")).alias("same"), (F.col("u") == F.col("v")).alias("loop"))
    inside = F.col("same") & (F.col("x.first") == 1)
    return ends.groupBy(F.col("x.com").alias("com")).agg(F.sum("weight").alias("degree"), F.sum(F.when(inside, F.col("weight")).otherwise(0)).alias("internal"), F.sum(F.when(inside & F.col("loop"), F.col("weight")).otherwise(0)).alias("loops"))


def weighted_modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    state = community_state(edges, labels)
    m = F.lit(float(weighted(edges).agg(F.sum("weight")).first()[0] or 1))
    share = F.col("degree") / (2 * m)
    return state.agg(F.sum(resolution * F.col("internal") / m - share * share).alias("modularity"))


def louvain(edges: DataFrame, rounds: int = 8, seed: int = 700) -> DataFrame:
    """(id, com): synchronous local moves by modularity gain, half of the nodes by draw in each round, best result kept.
    edges: (u, v) or (u, v, weight), loops allowed."""
    e = cut_lineage(weighted(edges))
    if e.count() <= min(ROUNDS_EDGES, ALONE_EDGES):
        return cut_lineage(in_one_task(e, lambda graph: _moves(graph, rounds, seed), "id long, com long", "weight"))
    return _joined_louvain(e, rounds, seed)


def _moves(graph: paths.Adjacency, rounds: int = 8, seed: int = 700) -> list[np.ndarray]:
    n, at, to, w = len(graph.ids), graph.at, graph.to, graph.more.get("weight")
    deg = graph.deg if w is None else np.add.reduceat(w.astype(np.int64), at[:-1])
    m = int(deg.sum()) // 2 or 1
    ends = np.unique(np.append(np.searchsorted(at, np.arange(0, len(to), MOVED_ARCS)), n)).tolist()
    pieces = list(zip(ends, ends[1:]))  # runs of nodes, so that little is held at once
    labels = best = np.arange(n)
    best_q = None
    for r in range(rounds):
        tot, pick = np.bincount(labels, deg, n).astype(np.int64), np.empty(n, np.int64)
        for a, b in pieces:
            arcs, some = slice(at[a], at[b]), np.arange(b - a)
            src, dst = np.repeat(some, graph.deg[a:b]), to[arcs]
            other = src + a != dst
            key = np.concatenate([src[other] << 32 | labels[dst[other]], some << 32 | labels[a:b]])
            order = np.argsort(key)
            key = key[order]
            weight = np.concatenate([np.ones(len(key) - len(some), np.int64) if w is None else w[arcs][other].astype(np.int64), np.zeros(len(some), np.int64)])
            first = np.flatnonzero(np.diff(key, prepend=-1))
            near, node, com = np.add.reduceat(weight[order], first), key[first] >> 32, key[first] & 0xFFFFFFFF
            rest = tot[com] - np.where(com == labels[a:b][node], deg[a:b][node], 0)
            gain = np.round(near - rest * deg[a:b][node] / (2.0 * m), 9)
            most = np.maximum.reduceat(gain, np.searchsorted(node, some))
            top = np.flatnonzero(gain == most[node])  # the least community on ties
            pick[a:b] = com[top[np.searchsorted(node[top], some)]]
        labels = np.where(drawn(graph.ids, seed + r) % 2 == 0, pick, labels)
        inside = 0
        for a, b in pieces:
            same = np.repeat(labels[a:b], graph.deg[a:b]) == labels[to[at[a] : at[b]]]
            inside += int(np.count_nonzero(same) if w is None else w[at[a] : at[b]][same].sum(dtype=np.int64))
        share = np.bincount(labels, deg, n) / (2.0 * m)
        q = round(float(inside // 2 / m - (share * share).sum()), 9)
        if best_q is None or q > best_q:
            best, best_q = labels, q
    return [graph.ids, graph.ids[best]]


def _joined_louvain(e: DataFrame, rounds: int, seed: int) -> DataFrame:
    m = e.agg(F.sum("weight")).first()[0] or 1
    s = cut_lineage(e.where("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"), "weight"))).alias("x")).select("x.*"))
    deg = cut_lineage(e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "weight"), F.struct(F.col("v").alias("id"), "weight"))).alias("x")).groupBy(F.col("x.id").alias("id")).agg(F.sum("x.weight").alias("deg")))
    labels = cut_lineage(deg.select("id", F.col("id").alias("com")))
    best, best_q = labels, None
    for r in range(rounds):
        tot = labels.join(deg, "id").groupBy("com").agg(F.sum("deg").alias("tot"))
        near = s.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "com").agg(F.sum("weight").alias("w"))
        near = near.unionByName(labels.select("id", "com", F.lit(0).cast("long").alias("w"))).groupBy("id", "com").agg(F.sum("w").alias("w"))
        x = near.join(tot, "com").join(deg, "id").join(labels.withColumnRenamed("com", "mine"), "id")
        rest = F.col("tot") - F.when(F.col("com") == F.col("mine"), F.col("deg")).otherwise(0)
        x = x.withColumn("gain", F.col("w") - rest * F.col("deg") / F.lit(2.0 * m))
        pick = x.groupBy("id").agg(F.max_by("com", F.struct(F.round("gain", 9), -F.col("com"))).alias("best"), F.first("mine").alias("mine"))
        labels = cut_lineage(pick.select("id", F.when(draw(F.col("id"), seed + r) % 2 == 0, F.col("best")).otherwise(F.col("mine")).alias("com")))
        q = round(weighted_modularity(e, labels).first()[0] or 0.0, 9)
        if best_q is None or q > best_q:
            best, best_q = labels, q
    return best


def louvain_levels(edges: DataFrame, rounds: int = 8, least_gain: float = 1e-6) -> DataFrame:
    """(level, node, com): communities of the nodes, then of the graph of communities, as long as modularity grows. Level 0
    names nodes of the graph, level k communities of level k - 1; an empty graph has no levels."""
    own, q, levels, level = cut_lineage(weighted(edges)), -1.0, None, 0
    while not own.isEmpty():
        labels = renumbered(louvain(own, rounds))
        labels = cut_lineage(labels)
        new = weighted_modularity(own, labels).first()[0] or 0.0
        if level and new - q < least_gain:
            break
        part = labels.select(F.lit(level).cast("long").alias("level"), F.col("id").alias("node"), "com")
        levels = part if levels is None else levels.unionByName(part)
        q, level, own = new, level + 1, cut_lineage(weighted_quotient(own, labels))
    return levels if levels is not None else edges.select(F.lit(0).cast("long").alias("level"), F.col("u").alias("node"), F.col("u").alias("com")).limit(0)


def partition_at_level(levels: DataFrame, level: int) -> DataFrame:
    """(id, com): the communities of the nodes at a level."""
    out = levels.where("level = 0").select(F.col("node").alias("id"), "com")
    for k in range(1, level + 1):
        up = levels.where(F.col("level") == k).select(F.col("node").alias("com"), F.col("com").alias("up"))
        out = out.join(up, "com").select("id", F.col("up").alias("com"))
    return out


def best_partition(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, com) at the last level."""
    levels = cut_lineage(louvain_levels(edges, rounds))
    top = levels.agg(F.max("level")).first()[0]
    return partition_at_level(levels, top or 0)


def eigenvector_centrality(edges: DataFrame, steps: int = 30) -> DataFrame:
    """(id, centrality): power iteration on A + I, normalised to length 1."""
    edges = cut_lineage(edges.select("u", "v"))
    if edges.count() <= min(ROUNDS_EDGES, ALONE_EDGES):
        return cut_lineage(in_one_task(edges, lambda graph: [graph.ids, _iterated(graph, steps)], "id long, centrality double"))
    return _joined_centrality(edges, steps)


def _iterated(graph: paths.Adjacency, steps: int = 30) -> np.ndarray:
    x = np.ones(len(graph.ids))
    for k in range(steps):
        x = x + np.add.reduceat(x[graph.to], graph.at[:-1])
        if k % 5 == 4 or k == steps - 1:
            x = x / (np.sqrt(x @ x) or 1.0)
    return x


def _joined_centrality(edges: DataFrame, steps: int) -> DataFrame:
    s = cut_lineage(structure.symmetric(edges))
    x = structure.vertices(edges).withColumn("x", F.lit(1.0))
    for k in range(steps):
        near = s.join(x, F.col("dst") == F.col("id")).groupBy("src").agg(F.sum("x").alias("y"))
        y = x.join(near, F.col("id") == F.col("src")).select("id", (F.col("x") + F.col("y")).alias("x"))
        if k % 5 == 4 or k == steps - 1:
            y = cut_lineage(y)
            norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
            y = y.select("id", (F.col("x") / norm).alias("x"))
        x = y
    return x.withColumnRenamed("x", "centrality")


def node_measures(edges: DataFrame, graph) -> DataFrame:
    """(id, deg, triangles, clustering, com, value, near, inside) of a graph of up to ROUNDS_EDGES edges without loops, that is
    held: what node_base, louvain and eigenvector_centrality give, the sum of the neighbours' degrees, and how many neighbours
    are of the same community, in one task."""
    from . import worlds

    def work(own: paths.Adjacency) -> list[np.ndarray]:
        src = np.repeat(np.arange(len(own.ids), dtype=np.int32), own.deg)
        up = src < own.to
        u, v = src[up].astype(np.int64), own.to[up].astype(np.int64)
        del src, up
        t = worlds.node_triangles(len(own.ids), u, v, worlds.triangle_counts(own.deg, u, v))
        del u, v
        com = _moves(own)[1]
        inside = com[own.to]
        inside = np.add.reduceat(np.repeat(com, own.deg) == inside, own.at[:-1], dtype=np.int64)
        near = np.add.reduceat(own.deg[own.to], own.at[:-1])
        return [own.ids, own.deg, t, worlds.clustering(own.deg, t), com, _iterated(own), near, inside]

    return in_one_task(edges, work, "id long, deg long, triangles long, clustering double, com long, value double, near long, inside long", graph=graph)


def modularity_of(nodes: DataFrame) -> DataFrame:
    """modularity, of node_measures."""
    com = nodes.groupBy("com").agg(F.sum("deg").alias("dg"), F.sum("inside").alias("twice"))
    m = F.col("m")
    share = F.col("dg") / (2 * m)
    return com.crossJoin(F.broadcast(nodes.agg((F.sum("deg") / 2).alias("m")))).agg(F.sum(F.col("twice") / 2 / m - share * share).alias("modularity"))
