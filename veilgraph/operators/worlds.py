"""Sampled worlds: many graphs as one table (world, u, v), each drawn, perturbed and measured in the same plan.

A world is numbered; its draws depend on its number and the node's or edge's key alone. Ids of a world's graph are
tagged with its number where operators on one graph run over all worlds at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import laplace, uniform
from ..functions.noise import P, draw, drawn
from ..session import cut_lineage
from . import paths, structure

#: Distance of the ids of two worlds.
TAG = 1_000_000_000
#: Draws fall into so many steps; only the step in which a group's limit lies is ranked.
STEPS_SHIFT = 15
#: Draws of a world that are numbered by one row.
DRAWS = 10_000


def targets(rows: DataFrame, key: Column, k: int, stream: int = 201) -> DataFrame:
    """k rows by draw, numbered from 0 in order of the draw."""
    chosen = rows.withColumn("__d", draw(key, stream)).withColumn("__k", key).orderBy("__d", "__k").limit(k)
    return chosen.withColumn("target_no", (F.row_number().over(Window.orderBy("__d", "__k")) - 1).cast("long")).drop("__d", "__k")


def first_of_each(rows: DataFrame, group: str, draws: Column, key: str, limit: str) -> DataFrame:
    """Of each group the first `limit` rows (a column, equal within a group) by (draw, key). Counts by step of the draw find
    the step in which the limit lies; rows before it are in, and only the rows of that step are ranked."""
    rows = rows.withColumn("__d", draws).withColumn("__s", F.shiftright("__d", STEPS_SHIFT))
    steps = rows.groupBy(group, "__s").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("__before", before).select(group, "__s", "__n", "__before")
    placed = rows.join(steps, [group, "__s"]).where(F.col("__before") < F.col(limit))
    whole = placed.where(F.col("__before") + F.col("__n") <= F.col(limit))
    part = placed.where(F.col("__before") + F.col("__n") > F.col(limit))
    rank = F.row_number().over(Window.partitionBy(group, "__s").orderBy("__d", key))
    part = part.withColumn("__r", rank).where(F.col("__before") + F.col("__r") <= F.col(limit)).drop("__r")
    return whole.unionByName(part).drop("__d", "__s", "__n", "__before")


def base_nodes(nodes: DataFrame, worlds: DataFrame, share: float = 0.8, spread: int = 5, stream: int = 211) -> DataFrame:
    """worlds: (world, target). (world, id): floor(share * nodes) +- spread nodes of each world by draw, without its target."""
    n = nodes.count()
    w = worlds.withColumn("k", F.greatest(F.lit(1), F.lit(math.floor(share * n)) + draw(F.col("world"), stream) % (2 * spread + 1) - spread))
    rows = nodes.select("id").crossJoin(F.broadcast(w)).where("id <> target")
    return first_of_each(rows, "world", draw(F.col("id") * 4099 + F.col("world"), stream + 1), "id", "k").select("world", "id")


def training_nodes(nodes: DataFrame, worlds: DataFrame, least: int = 10, stream: int = 221) -> DataFrame:
    """worlds: (world, target, st). (world, id): 60 to 80 % of the nodes, least at least; the target is in if st is 1, else not."""
    n = nodes.count()
    w = worlds.withColumn("k", F.greatest(F.lit(least), F.floor(F.lit(n) * (0.6 + 0.2 * uniform(F.col("world"), stream)))).cast("long"))
    rows = nodes.select("id").crossJoin(F.broadcast(w)).where("id <> target")
    chosen = first_of_each(rows, "world", draw(F.col("id") * 4099 + F.col("world"), stream + 1), "id", "k").select("world", "id")
    return chosen.unionByName(worlds.where("st = 1").select("world", F.col("target").alias("id")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(world, u, v): the edges of each world with both ends in nodes (world, id)."""
    return edges.join(nodes.select("world", F.col("id").alias("u")), "u").join(nodes.select("world", F.col("id").alias("v")), ["world", "v"]).select("world", "u", "v")


def inserted(edges: DataFrame, nodes: DataFrame, worlds: DataFrame, most: int = 3, stream: int = 231) -> DataFrame:
    """(world, u, v): edges from each world's target to 1 to `most` of its neighbours in the base, by draw; none where it has
    no neighbour there."""
    near = structure.symmetric(edges).join(F.broadcast(worlds.select("world", F.col("target").alias("src"))), "src")
    near = near.join(nodes.select("world", F.col("id").alias("dst")), ["world", "dst"])
    rank = F.row_number().over(Window.partitionBy("world").orderBy(draw(F.col("dst") * 4099 + F.col("world"), stream), "dst"))
    few = near.withColumn("r", rank).where(F.col("r") <= 1 + draw(F.col("world"), stream + 1) % most)
    return few.select("world", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


def replacements(nodes: DataFrame, base: DataFrame, worlds: DataFrame, stream: int = 241) -> DataFrame:
    """(world, target): of each world a node that is neither its target nor in its base, the first by draw."""
    rows = nodes.select("id").crossJoin(F.broadcast(worlds.select("world", "target"))).where("id <> target").join(base, ["world", "id"], "left_anti")
    return rows.groupBy("world").agg(F.min_by("id", F.struct(draw(F.col("id") * 4099 + F.col("world"), stream).alias("d"), "id")).alias("target"))


def shadow_worlds(edges: DataFrame, worlds: DataFrame, share: float = 0.8) -> DataFrame:
    """worlds: (world, target, bit). (world, u, v): the base graph with the target if bit is 1, else with a replacement."""
    nodes = cut_lineage(structure.vertices(edges))
    base = cut_lineage(base_nodes(nodes, worlds, share))
    put = worlds.where("bit = 1").select("world", "target").unionByName(replacements(nodes, base, worlds.where("bit = 0")))
    return induced(edges, base).unionByName(inserted(edges, base, put)).distinct()


def edge_worlds(edges: DataFrame, worlds: DataFrame, share: float = 0.7, stream: int = 251) -> DataFrame:
    """worlds: (world, u, v, bit). Training graphs of edge targets: a share of the nodes, both ends always, the target edge
    only if bit is 1."""
    nodes = structure.vertices(edges)
    k = max(5, math.floor(share * nodes.count()))
    w = worlds.select("world", F.col("u").alias("tu"), F.col("v").alias("tv"), "bit").withColumn("k", F.lit(k))
    rows = nodes.crossJoin(F.broadcast(w)).where("id <> tu AND id <> tv")
    chosen = first_of_each(rows, "world", draw(F.col("id") * 4099 + F.col("world"), stream), "id", "k").select("world", "id")
    chosen = chosen.unionByName(w.select("world", F.explode(F.array("tu", "tv")).alias("id")))
    out = induced(edges, chosen).join(F.broadcast(w.select("world", "tu", "tv", "bit")), "world")
    return out.where("NOT (bit = 0 AND u = tu AND v = tv)").select("world", "u", "v")


def thresholds(worlds: DataFrame) -> DataFrame:
    """worlds: (world, n, mt, eps1). Adds theta, the threshold of the filter of noisy cells, and leaves out worlds without pairs."""
    cells = F.col("n") * (F.col("n") - 1) / 2
    limit = F.ln(F.greatest(cells / F.col("mt") - 1, F.lit(1e-12)))
    # in log space: ln(a + b) for a = cells / (2 mt) - 1/2 and b = exp(eps1) / 2
    a = F.ln(F.greatest(cells / (2 * F.col("mt")) - 0.5, F.lit(1e-300)))
    b = F.col("eps1") + math.log(0.5)
    both = F.greatest(a, b) + F.ln(F.exp(a - F.greatest(a, b)) + F.exp(b - F.greatest(a, b)))
    theta = F.when(F.col("mt") <= 0, F.lit(float("inf"))).otherwise(F.when(F.col("eps1") < limit, limit / (2 * F.col("eps1"))).otherwise(both / F.col("eps1")))
    return worlds.where("n >= 2").withColumn("theta", theta)


def kept_edges(graphs: DataFrame, epsilons: DataFrame, stream: int = 261) -> DataFrame:
    """(world, u, v): the edges whose noisy cell passes their world's threshold."""
    return _kept(graphs, _sizes(graphs, epsilons, stream), stream)


def _sizes(graphs: DataFrame, epsilons: DataFrame, stream: int) -> DataFrame:
    nodes = graphs.select("world", F.explode(F.array("u", "v")).alias("id")).distinct().groupBy("world").agg(F.count("*").alias("n"))
    size = graphs.groupBy("world").agg(F.count("*").alias("m")).join(nodes, "world").join(F.broadcast(epsilons), "world")
    size = size.withColumn("eps1", F.col("epsilon") / 2).withColumn("mt", F.greatest(F.col("m") + laplace(uniform(F.col("world"), stream), 1 / F.col("eps1")), F.lit(0.0)))
    return cut_lineage(thresholds(size))


def _kept(graphs: DataFrame, size: DataFrame, stream: int) -> DataFrame:
    cell = F.col("u") * 2000003 + F.col("v") + F.col("world") * 7919
    kept = graphs.join(F.broadcast(size.select("world", "eps1", "theta")), "world").where(F.greatest(1 + laplace(uniform(cell, stream + 1), 1 / F.col("eps1")), F.lit(0.0)) > F.col("theta"))
    return cut_lineage(kept.select("world", "u", "v"))


def perturbed(graphs: DataFrame, epsilons: DataFrame, stream: int = 261) -> DataFrame:
    """graphs: (world, u, v); epsilons: (world, epsilon). The top-m filter on every world at once: a noisy number of edges,
    edges whose noisy cell passes the threshold, and drawn pairs for the rest."""
    nodes = graphs.select("world", F.explode(F.array("u", "v")).alias("id")).distinct()
    rank = (F.row_number().over(Window.partitionBy("world").orderBy("id")) - 1).cast("long")
    ids = cut_lineage(nodes.select("world", "id", rank.alias("idx")))
    size = _sizes(graphs, epsilons, stream)
    kept = _kept(graphs, size, stream)
    left = size.join(kept.groupBy("world").agg(F.count("*").alias("have")), "world", "left").withColumn("more", F.ceil(F.col("mt") - F.coalesce("have", F.lit(0)))).where("more > 0")
    # numbered in two steps, so that no row holds all numbers of a world and worlds are spread over tasks
    tens = left.select("world", "n", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((2 * F.col("more") + 100) / DRAWS))).alias("ten"))
    tens = tens.repartition(4 * graphs.sparkSession.sparkContext.defaultParallelism, "world", "ten")
    rows = tens.select("world", "n", "more", F.explode(F.sequence(F.col("ten") * DRAWS, F.least(F.col("ten") * DRAWS + DRAWS - 1, 2 * F.col("more") + 100))).alias("i"))
    key = F.col("i") * 4099 + F.col("world")
    rows = rows.select("world", "more", "i", (draw(key, stream + 2) % F.col("n")).alias("a"), (draw(key, stream + 3) % F.col("n")).alias("b")).where("a <> b")
    for c in "ab":
        rows = rows.join(ids.select("world", F.col("idx").alias(c), F.col("id").alias(f"id_{c}")), ["world", c])
    pairs = rows.groupBy("world", "more", F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).agg(F.min("i").alias("i")).join(kept, ["world", "u", "v"], "left_anti")
    return kept.unionByName(first_of_each(pairs, "world", F.col("i"), "i", "more").select("world", "u", "v"))


def tagged(graphs: DataFrame) -> DataFrame:
    """One graph of all worlds."""
    w = F.col("world") * TAG
    return graphs.select((w + F.col("u")).alias("u"), (w + F.col("v")).alias("v"))


def of_world(df: DataFrame, key: str = "id") -> DataFrame:
    """A table by tagged id as (world, id, ...)."""
    return df.withColumn("world", F.floor(F.col(key) / TAG)).withColumn(key, F.col(key) % TAG)


#: Names of a world's ten features of a node target.
NODE_FEATURES = ("n", "m", "mean_degree", "std_degree", "max_degree", "min_degree", "avg_clustering", "transitivity", "two_hop_density", "two_hop_mean_degree")
#: Names of the ten features of an edge target; the last two are always 0.
EDGE_FEATURES = ("present", "common_neighbors", "degree_product", "betweenness", "end_triangles", "jaccard", "degree_difference", "mean_clustering", "pad_1", "pad_2")


def padded(values: list[Column], length: int = 10) -> Column:
    """The first `length` values as an array, 0 for those that are missing."""
    return F.slice(F.concat(F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]), F.array_repeat(F.lit(0.0), length)), 1, length)


def node_target_features(graphs: DataFrame, worlds: DataFrame) -> DataFrame:
    """graphs: (world, u, v); worlds: (world, target). (world, features): size, degrees and clustering of each world's graph,
    density and mean degree among what is within two steps of the target; zeros where it is not in the graph."""
    e = cut_lineage(tagged(graphs))
    base = cut_lineage(of_world(structure.node_base(e)))
    d = F.col("deg")
    whole = base.groupBy("world").agg(F.count("*").alias("n"), (F.sum(d) / 2).alias("m"), F.avg(d).alias("mean_degree"), F.stddev_pop(d).alias("std_degree"), F.max(d).alias("max_degree"), F.min(d).alias("min_degree"),
                                      F.avg("clustering").alias("avg_clustering"), F.coalesce(F.try_divide(F.sum("triangles"), F.sum(d * (d - 1) / 2)), F.lit(0.0)).alias("transitivity"))
    s = structure.symmetric(e)
    start = F.broadcast(worlds.select((F.col("world") * TAG + F.col("target")).alias("src")))
    one = s.join(start, "src").select(F.col("src").alias("t"), F.col("dst").alias("w"))
    two = one.select("t", F.col("w").alias("src")).join(s, "src").select("t", F.col("dst").alias("w"))
    near = cut_lineage(one.unionByName(two).where("w <> t").distinct())
    degrees = base.select((F.col("world") * TAG + F.col("id")).alias("w"), "deg")
    size = near.join(degrees, "w").groupBy("t").agg(F.count("*").alias("k"), F.avg("deg").alias("two_hop_mean_degree"))
    inside = near.select("t", F.col("w").alias("u")).join(e, "u").join(near.select("t", F.col("w").alias("v")), ["t", "v"]).groupBy("t").agg(F.count("*").alias("inside"))
    hop = size.join(inside, "t", "left").select(F.floor(F.col("t") / TAG).alias("world"), "two_hop_mean_degree", F.coalesce(F.try_divide(2.0 * F.coalesce("inside", F.lit(0)), F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("two_hop_density"))
    rows = worlds.join(whole, "world", "left").join(hop, "world", "left")
    return rows.select("world", padded([F.col(c) for c in NODE_FEATURES]).alias("features"))


def edge_target_features(graphs: DataFrame, worlds: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """worlds: (world, u, v). (world, features): ten features of the pair in each world's graph; zeros if an end is missing."""
    e = cut_lineage(tagged(graphs))
    base = cut_lineage(structure.node_base(e))
    pair = worlds.select("world", (F.col("world") * TAG + F.least("u", "v")).alias("u"), (F.col("world") * TAG + F.greatest("u", "v")).alias("v"))
    s = structure.symmetric(e)
    common = pair.join(s.select(F.col("src").alias("u"), F.col("dst").alias("w")), "u").join(s.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"]).groupBy("world").agg(F.count("*").alias("common_neighbors"))
    here = pair.join(e, ["u", "v"], "left_semi").select("world", F.lit(1).alias("present"))
    rows = pair.join(common, "world", "left").join(here, "world", "left")
    for c in "uv":
        rows = rows.join(base.select(F.col("id").alias(c), F.col("deg").alias(f"d{c}"), F.col("triangles").alias(f"t{c}"), F.col("clustering").alias(f"c{c}")), c, "left")
    both = F.col("du").isNotNull() & F.col("dv").isNotNull()
    rows = rows.join(betweenness, ["u", "v"], "left") if betweenness is not None else rows.withColumn("betweenness", F.lit(0.0))
    n = F.coalesce("common_neighbors", F.lit(0))
    present = F.coalesce("present", F.lit(0))
    values = [present, n, F.col("du") * F.col("dv"), F.col("betweenness"), present * (F.col("tu") + F.col("tv")), F.try_divide(n, F.col("du") + F.col("dv") - n), F.abs(F.col("du") - F.col("dv")), (F.col("cu") + F.col("cv")) / 2]
    return rows.select("world", padded([F.when(both, v) for v in values]).alias("features"))


# ---------------------------------------------------------------- a world in one task

#: Numbers that are drawn at once.
DRAWN = 1 << 19


def _laplace(key: np.ndarray, stream: int, scale: float) -> np.ndarray:
    u = (drawn(key, stream) + 0.5) / float(P)
    return -scale * np.sign(u - 0.5) * np.log(1 - 2 * np.abs(u - 0.5))


class Worlds:
    """Draws worlds of a held graph one by one, the same as the tables above. Edges of a world are two arrays of places of
    ids, the lower first, in order."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray):
        """ids in order, and the edges as places of them, the lower first, in order."""
        self.ids, self.n, self.u, self.v = ids, len(ids), u, v

    def _chosen(self, world: int, k: int, stream: int, out: list[int]) -> np.ndarray:
        """Marks the first k nodes by draw, without those in out."""
        key = np.arange(self.n)
        for i in range(0, self.n, DRAWN):
            key[i : i + DRAWN] |= drawn(self.ids[i : i + DRAWN] * 4099 + world, stream) << 32
        key[out] = np.iinfo(np.int64).max
        inside = key <= np.partition(key, k - 1)[k - 1] if k <= self.n else np.ones(self.n, bool)
        inside[out] = False
        return inside

    def _within(self, inside: np.ndarray) -> np.ndarray:
        """Marks the edges with both ends inside."""
        here = np.empty(len(self.u), bool)
        for i in range(0, len(here), DRAWN):
            j = slice(i, i + DRAWN)
            here[j] = inside[self.u[j]] & inside[self.v[j]]
        return here

    def edge_world(self, world: int, u: int, v: int, bit: int, share: float = 0.7, stream: int = 251) -> tuple[np.ndarray, np.ndarray]:
        """A world of edge_worlds(); u and v are places."""
        inside = self._chosen(world, max(5, math.floor(share * self.n)), stream, [u, v])
        inside[[u, v]] = True
        here = self._within(inside)
        if not bit:
            here &= (self.u != u) | (self.v != v)
        return self.u[here], self.v[here]

    def training_world(self, world: int, target: int, st: int, least: int = 10, stream: int = 221) -> tuple[np.ndarray, np.ndarray]:
        """The edges among a world's training_nodes(); target is a place."""
        part = (drawn(np.array([world], np.int64), stream)[0] + 0.5) / float(P)
        inside = self._chosen(world, max(least, math.floor(self.n * (0.6 + 0.2 * part))), stream + 1, [target])
        inside[target] = bool(st)
        here = self._within(inside)
        return self.u[here], self.v[here]

    def node_world(self, world: int, target: int, bit: int, share: float = 0.8, spread: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """A world of shadow_worlds(); target is a place."""
        w = np.array([world], np.int64)
        base = self._chosen(world, max(1, math.floor(share * self.n) + int(drawn(w, 211)[0]) % (2 * spread + 1) - spread), 212, [target])
        here = self._within(base)
        u, v, put = self.u[here], self.v[here], target
        if not bit:
            base[target] = True  # no replacement of itself
            rest = np.flatnonzero(~base)
            base[target] = False
            if not len(rest):
                return u, v
            put = int(rest[drawn(self.ids[rest] * 4099 + world, 241).argmin()])
        near = np.concatenate([self.u[self.v == put], self.v[self.u == put]])
        near = near[base[near]]
        few = near[np.lexsort((near, drawn(self.ids[near] * 4099 + world, 231)))][: 1 + int(drawn(w, 232)[0]) % 3]
        new = sorted((min(put, x), max(put, x)) for x in few.tolist())
        first = [int(np.searchsorted(u, a)) for a, _ in new]
        at = [i + int(np.searchsorted(v[i : np.searchsorted(u, a, "right")], b)) for i, (a, b) in zip(first, new, strict=True)]
        return tuple(np.insert(x, at, [e[side] for e in new]) for side, x in enumerate((u, v))) if new else (u, v)

    def perturbed(self, world: int, u: np.ndarray, v: np.ndarray, epsilon: float, stream: int = 261) -> tuple[np.ndarray, np.ndarray]:
        """A world of perturbed(); its drawn edges stand after those that are kept."""
        mark = np.zeros(self.n, bool)
        mark[u] = True
        mark[v] = True
        nodes = np.flatnonzero(mark).astype(np.int32)  # places by rank
        rank = (np.cumsum(mark) - 1).astype(np.int32)
        m, n, eps1, w = len(u), len(nodes), epsilon / 2, np.array([world], np.int64)
        mt = max(m + float(_laplace(w, stream, 1 / eps1)[0]), 0.0)
        if n < 2 or mt <= 0:
            return u[:0], v[:0]
        cells = n * (n - 1) / 2
        limit, a, b = math.log(max(cells / mt - 1, 1e-12)), math.log(max(cells / (2 * mt) - 0.5, 1e-300)), eps1 + math.log(0.5)
        theta = limit / (2 * eps1) if eps1 < limit else (max(a, b) + math.log(math.exp(a - max(a, b)) + math.exp(b - max(a, b)))) / eps1
        kept = np.zeros(m, bool)
        for i in range(0, m, DRAWN):
            j = slice(i, i + DRAWN)
            cell = self.ids[u[j]] * 2000003 + self.ids[v[j]] + world * 7919
            kept[j] = np.maximum(1 + _laplace(cell, stream + 1, 1 / eps1), 0) > theta
        u, v = u[kept], v[kept]
        more = math.ceil(mt - len(u))
        if more <= 0:
            return u, v
        pair = np.empty(2 * more + 101, np.int64)
        for i in range(0, len(pair), DRAWN):
            key = np.arange(i, min(i + DRAWN, len(pair))) * 4099 + world
            a, b = drawn(key, stream + 2) % n, drawn(key, stream + 3) % n
            pair[i : i + DRAWN] = np.where(a == b, -1, np.minimum(a, b) << 32 | np.maximum(a, b))
        known, first, part = rank[u].astype(np.int64) << 32 | rank[v], [], -(-n // (1 + len(pair) // DRAWN))
        for low in range(0, n, part):  # by lower ends, as an executor's tasks do this side by side
            which = np.flatnonzero((pair >= low << 32) & (pair < (low + part) << 32)).astype(np.int32)
            one = pair[which]
            order = np.argsort(one, kind="stable")  # the first of equal pairs is that of the least number
            one, which = one[order], which[order]
            new = np.ones(len(one), bool)
            new[1:] = one[1:] != one[:-1]
            if len(known):
                new &= known[np.minimum(np.searchsorted(known, one), len(known) - 1)] != one
            first.append(which[new])
        first = np.concatenate(first)
        if len(first) > more:
            first = first[first <= np.partition(first, more - 1)[more - 1]]
        pair = pair[first]
        return np.concatenate([u, nodes[pair >> 32]]), np.concatenate([v, nodes[pair & 0xFFFFFFFF]])

    def edge_features(self, u: np.ndarray, v: np.ndarray, a: int, b: int) -> list[float]:
        """The features of edge_target_features() of the pair of places a and b, without betweenness."""
        near, deg, ratio, closed = [], [], [], []
        for x in (a, b):
            mark = np.zeros(self.n, bool)
            mark[v[u == x]] = True
            mark[u[v == x]] = True
            near.append(mark)
            d, t = int(mark.sum()), int((mark[u] & mark[v]).sum())
            deg.append(d)
            closed.append(t)
            ratio.append(2.0 * t / (d * (d - 1)) if d > 1 else 0.0)
        if not all(deg):
            return [0.0] * 10
        n, present = int((near[0] & near[1]).sum()), int(near[0][b])
        return [float(x) for x in (present, n, deg[0] * deg[1], 0, present * sum(closed), n / (sum(deg) - n), abs(deg[0] - deg[1]), sum(ratio) / 2, 0, 0)]


    def node_features(self, u: np.ndarray, v: np.ndarray, target: int) -> list[float]:
        """The features of node_target_features() of the place target."""
        if not len(u):
            return [0.0] * 10
        deg = np.bincount(u, minlength=self.n) + np.bincount(v, minlength=self.n)
        t, hop = node_triangles(self.n, u, v, triangle_counts(deg, u, v))[deg > 0], [0.0, 0.0]
        d = deg[deg > 0]
        pairs = int((d * (d - 1)).sum())
        whole = [len(d), d.sum() / 2, d.mean(), d.std(), d.max(), d.min(), clustering(d, t).mean(), 2.0 * int(t.sum()) / pairs if pairs else 0.0]
        if deg[target]:
            one = np.zeros(self.n, bool)
            one[v[u == target]] = True
            one[u[v == target]] = True
            near = one.copy()
            near[v[one[u]]] = True
            near[u[one[v]]] = True
            near[target] = False
            k = int(near.sum())
            hop = [2.0 * int((near[u] & near[v]).sum()) / (k * (k - 1)) if k > 1 else 0.0, deg[near].mean()]
        return [float(x) for x in (*whole, *hop)]


# ---------------------------------------------------------------- attributes of a held graph

#: Paths of two steps that are met at once, and bits of the table that tells most pairs that are no edges.
PATHS, PAIR_BITS = 1 << 20, 25


def _pieces(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about PATHS items together, or one row."""
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PATHS, "right")))
        yield i, j
        i = j


def triangle_counts(deg: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each edge the triangles that hold it. Edges go from the end of lower degree to the other, so that a hub never meets
    itself; of two edges that go out from a node, most that no third one closes are told by a table of bits."""
    m, rank = len(u), np.empty(len(deg), np.int32)
    rank[np.argsort(deg, kind="stable")] = np.arange(len(deg), dtype=np.int32)
    key = rank[u].astype(np.int64), rank[v]
    key = np.minimum(*key) << 32 | np.maximum(*key)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    to, start = key & 0xFFFFFFFF, key >> 32
    later = np.cumsum(np.bincount(start, minlength=len(deg)))[start] - 1 - np.arange(m)
    del start
    place = lambda k: (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
    known = np.zeros(1 << PAIR_BITS, bool)
    for i in range(0, m, PATHS):
        known[place(key[i : i + PATHS])] = True
    common = np.zeros(m, np.int32)
    for i, j in _pieces(later):
        size = later[i:j]
        first = np.cumsum(size) - size
        shift = np.arange(i + 1, j + 1) - first  # of each edge its later ones stand after it
        pair = to[np.arange(size.sum()) + np.repeat(shift, size)]
        pair |= np.repeat(to[i:j] << 32, size)
        some = np.flatnonzero(known[place(pair)])
        at = np.minimum(np.searchsorted(key, pair[some]), m - 1)
        hit = key[at] == pair[some]
        some = some[hit]
        one = np.searchsorted(first + size, some, "right")
        for edge in (one + i, some + shift[one], at[hit]):
            np.add.at(common, edge, 1)
    back = np.empty_like(common)
    back[order] = common
    return back


def node_triangles(n: int, u: np.ndarray, v: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each node the triangles that hold it, by those of the edges."""
    some = np.flatnonzero(common)
    return np.bincount(np.concatenate([u[some], v[some]]), np.concatenate([common[some]] * 2), n).astype(np.int64) // 2


def clustering(deg: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    return np.divide(2.0 * triangles, deg * (deg - 1), out=np.zeros(len(deg)), where=deg > 1)


def node_table(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Places of the nodes with an edge, and their attributes as structure.node_features() has them."""
    deg = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    t = node_triangles(n, u, v, triangle_counts(deg, u, v))
    ratio = clustering(deg, t)
    key = np.concatenate([u.astype(np.int64) << 32 | v, v.astype(np.int64) << 32 | u])
    key.sort()
    to = (key & 0xFFFFFFFF).astype(np.int32)
    near = np.bincount(key >> 32, deg[to], n)
    del key
    graph = paths.Adjacency(np.arange(n), np.concatenate([[0], np.cumsum(deg)]), to, {})
    second, here = np.zeros(n, np.int64), np.flatnonzero(deg)
    ends = np.concatenate([[0], np.cumsum(deg[to])])  # of each arc's end all arcs
    for i, j in _pieces(ends[graph.at[here + 1]] - ends[graph.at[here]]):
        arcs, size = graph.reach(here[i:j])
        row = np.repeat(here[i:j], size)
        two, more = graph.reach(to[arcs])
        row = np.repeat(row, more)
        two = to[two]
        pair = row[two != row] << 32 | two[two != row]
        pair.sort()
        second[here[i] : here[j - 1] + 1] += np.bincount((pair[np.diff(pair, prepend=-1) != 0] >> 32) - here[i], minlength=here[j - 1] - here[i] + 1)
    values = {"deg": deg, "triangles": t, "neighbor_connection_ratio": ratio, "neighbor_avg_degree": np.divide(near, deg, out=np.zeros(n), where=deg > 0), "second_neighbor_count": second}
    return here, {k: x[here].astype(float) for k, x in values.items()}


def combined(columns: list[np.ndarray]) -> np.ndarray:
    """Whole numbers from 0 that tell rows of whole numbers from 0 apart."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        times = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * times >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * times + c
    return key


def edge_table(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each edge its row, and the rows of attributes as structure.edge_features() has them. Edges of equal degrees and
    triangles share a row."""
    deg = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    common = triangle_counts(deg, u, v)
    t = node_triangles(n, u, v, common)
    end = combined([deg, t])
    swap = end[u] > end[v]
    _, first, row = np.unique(combined([common, end[np.where(swap, v, u)], end[np.where(swap, u, v)]]), return_index=True, return_inverse=True)
    c, a, b, ratio = common[first], u[first], v[first], clustering(deg, t)
    da, db = deg[a], deg[b]
    return row.astype(np.int32), {"common_neighbors": c.astype(float), "jaccard": c / (da + db - c), "preferential_attachment": (da * db).astype(float), "degree_difference": np.abs(da - db).astype(float), "mean_clustering": (ratio[a] + ratio[b]) / 2}


# ---------------------------------------------------------------- a world in one task: tables


def held_ends(edges: DataFrame):
    """The edges of a graph for all tasks, each once, as the arguments of Worlds."""
    graph = paths.held(edges)
    ids, at, to, _ = graph.value
    src = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))
    up = src < to
    ends = edges.sparkSession.sparkContext.broadcast((ids, src[up], to[up]))
    del at, to, src, up
    graph.destroy()  # tasks get each edge once
    return ends


def in_tasks(ends, rows: DataFrame, work, schema: str) -> DataFrame:
    """For each row, dealt over tasks by world, the row that work(worlds, *row) gives, if any."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Worlds(*ends.value)
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = work(own, *row)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], to_arrow_type(k.dataType)) for x, k in zip(out, kinds, strict=True)], kinds.names)

    return rows.repartitionById(tasks, F.pmod("world", F.lit(tasks)).cast("int")).mapInArrow(run, schema)


def edge_membership_features(edges: DataFrame, worlds: DataFrame) -> DataFrame:
    """worlds: (world, u, v, bit, epsilon). (world, features): of the perturbed training graph of each edge target. A world is
    drawn and measured in one task and never written where tasks can hold the graph."""
    if edges.count() > paths.BROADCAST_EDGES:
        fake = cut_lineage(perturbed(cut_lineage(edge_worlds(edges, worlds.select("world", "u", "v", "bit"))), worlds.select("world", "epsilon")))
        return edge_target_features(fake, worlds.select("world", "u", "v"))

    def work(own: Worlds, world, u, v, bit, epsilon):
        x, y = np.searchsorted(own.ids, sorted((u, v))).tolist()
        return world, own.edge_features(*own.perturbed(world, *own.edge_world(world, x, y, bit), epsilon), x, y)

    return in_tasks(held_ends(edges), worlds.select("world", "u", "v", "bit", F.col("epsilon").cast("double")), work, "world long, features array<double>")


def node_membership_features(edges: DataFrame, worlds: DataFrame) -> DataFrame:
    """worlds: (world, target, bit, epsilon). The same of node targets."""
    if edges.count() > paths.BROADCAST_EDGES:
        fake = cut_lineage(perturbed(cut_lineage(shadow_worlds(edges, worlds.select("world", "target", "bit"))), worlds.select("world", "epsilon")))
        return node_target_features(fake, worlds.select("world", "target"))

    def work(own: Worlds, world, target, bit, epsilon):
        x = int(np.searchsorted(own.ids, target))
        return world, own.node_features(*own.perturbed(world, *own.node_world(world, x, bit), epsilon), x)

    return in_tasks(held_ends(edges), worlds.select("world", "target", "bit", F.col("epsilon").cast("double")), work, "world long, features array<double>")
