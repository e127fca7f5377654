"""Components and distances.

Components: alternating large and small stars, a few joins a step. Distances: breadth-first from many sources at once, a bit
each, over a broadcast adjacency where the graph is small (BROADCAST_EDGES, checked), and by a frontier join where it isn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import structure

#: Edges up to which a graph is held by every task.
BROADCAST_EDGES = 20_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the component."""
    nodes, before = structure.vertices(edges), None
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    while True:
        both = structure.symmetric(e).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut_lineage(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))
        before = now


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component, the one of the least id on ties."""
    edges = cut_lineage(edges)
    c = cut_lineage(connected_components(edges))
    best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return edges.join(c.join(F.broadcast(best), "component").select(F.col("id").alias("u")), "u", "left_semi")


#: Neighbours of a node that are met one by one for all nodes at once; those beyond are met node by node.
COLUMNS = 64
#: Sources that are searched from side by side, a bit each; four times as many where a bit for each of them and each node
#: takes at most LANE_BYTES.
LANES, LANE_BYTES = 256, 1 << 24
#: Bytes of the rows of nodes that a step of a search meets at once.
STEP_BYTES = 1 << 18
#: Share of the nodes up to which a step of a search picks the nodes that it meets.
SOME = 0.7
#: Arcs of the front to those of the nodes that a step meets, below which only neighbours in the front are gathered; share of
#: the sources that a neighbour is expected to add from which a step looks for nodes that miss nothing more, and the share of
#: nodes left below which it goes on with these alone.
SPARSE, SOON, LEFT = 0.35, 0.2, 0.8


class Adjacency:
    """Compressed rows of a graph: the neighbours of node k, of all nodes in order of their ids, are to[at[k] : at[k + 1]].
    Columns of its edges, if any, lie beside: more[name][i] belongs to to[i]."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, to: np.ndarray, more: dict[str, np.ndarray]):
        self.ids, self.at, self.to, self.more = ids, at, to, more
        self.deg = np.diff(at)

    def reach(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs that leave nodes: their places in to, and how many each node has."""
        size = self.deg[nodes]
        return np.repeat(self.at[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum()), size

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The number of each id, -1 for those that are no nodes."""
        k = np.searchsorted(self.ids, ids)
        known = k < len(self.ids)
        known[known] = self.ids[k[known]] == ids[known]
        return np.where(known, k, -1)


def _any(rows: np.ndarray) -> np.ndarray:
    """Which rows hold a bit; there are few columns."""
    out = rows[:, 0].copy()
    for k in range(1, rows.shape[1]):
        out |= rows[:, k]
    return out != 0


class Search:
    """Breadth-first search from many sources at once, a bit each. Nodes stand in order of their degree, so that the j-th
    neighbours of all nodes that have so many are one step over a prefix."""

    def __init__(self, graph: Adjacency):
        order = np.argsort(-graph.deg, kind="stable")
        self.n, self.rank = len(order), np.empty(len(order), np.int64)
        self.rank[order] = np.arange(self.n)
        self.deg = deg = graph.deg[order]
        many = lambda j: int(np.searchsorted(-deg, -j, "left"))  # noqa: E731  nodes with more than j neighbours
        self.columns = [self.rank[graph.to[graph.at[order[: many(j)]] + j]].astype(np.int32) for j in range(min(COLUMNS, int(deg[0]) if self.n else 0))]
        hubs = order[: many(COLUMNS)]
        rest = graph.deg[hubs] - COLUMNS
        self.rest_at, self.rest_size = np.cumsum(rest) - rest, rest
        self.rest = self.rank[graph.to[np.repeat(graph.at[hubs] + COLUMNS - self.rest_at, rest) + np.arange(rest.sum())]]

    def levels(self, sources: np.ndarray) -> Iterator[np.ndarray]:
        """For each distance from 0 the nodes (by rank) that have it: [node, word], bit k % 64 of word k // 64 for source k, and
        self.count of such bits. A step meets only nodes next to the front that some source has not seen."""
        k = np.arange(len(sources))
        seen = np.zeros((self.n, -(-len(sources) // 64)), np.uint64)
        np.bitwise_or.at(seen, (self.rank[sources], k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        whole = np.bitwise_or.reduce(seen, axis=0)
        front, new, chunk = seen.copy(), np.zeros_like(seen), max(64, STEP_BYTES // (8 * seen.shape[1]))
        held = np.empty((chunk, seen.shape[1]), np.uint64)
        active, before, opened = np.unique(self.rank[sources]), np.zeros(0, np.int64), np.ones(self.n, bool)
        self.count = len(sources)
        while len(active):
            yield front
            near = self._next_to(active)
            near = near[opened[near]]
            arcs = max(1, int(self.deg[near].sum()))
            share = int(self.deg[active].sum()) / arcs
            mark = np.zeros(self.n, bool) if share < SPARSE else None
            if mark is not None:
                mark[active] = True
            soon = share * self.count / (len(active) * len(sources)) > SOON
            new[before] = 0
            self.count, hit = 0, []
            for i in range(0, len(near), chunk):  # few enough that what is gathered stays at hand
                some = near[i : i + chunk]
                place = slice(some[0], some[-1] + 1) if some[-1] - some[0] == len(some) - 1 else some
                miss = whole & ~seen[place]
                found = self._met(front, some, miss, mark, soon, held)
                found &= miss
                seen[place] |= found
                new[place] = found
                miss ^= found
                opened[place] = _any(miss)
                self.count += int(np.bitwise_count(found).sum(dtype=np.int64))
                hit.append(some[_any(found)])
            before, active = active, np.concatenate(hit) if hit else near
            front, new = new, front

    def _met(self, front: np.ndarray, some: np.ndarray, miss: np.ndarray, mark: np.ndarray | None, soon: bool, held: np.ndarray) -> np.ndarray:
        """The sum of the front's rows of the neighbours of some nodes, at least in the bits of miss. mark: the nodes of the
        front, if few neighbours are, so that the rest is passed over; soon: nodes that miss nothing more are left early."""
        out = found = np.zeros(miss.shape, np.uint64)
        at = None  # of found in out, if not all are met any more
        for j, to in enumerate(self.columns):
            if soon and j >= 4 and not j & 1 and len(some):
                left = np.flatnonzero(_any(miss & ~found))
                if len(left) < LEFT * len(some):
                    if at is not None:
                        out[at] = found
                    at = left if at is None else at[left]
                    some, miss, found = some[left], miss[left], found[left]
            own = some if not len(some) or some[-1] < len(to) else some[: np.searchsorted(some, len(to))]
            if not len(own):
                break
            to = to[own[0] : own[-1] + 1] if own[-1] - own[0] == len(own) - 1 else to[own]
            if mark is not None:
                hit = np.flatnonzero(mark[to])
                found[hit] |= front[to[hit]]
                continue
            part = np.take(front, to, axis=0, out=held[: len(own)], mode="clip")
            np.bitwise_or(found[: len(own)], part, out=found[: len(own)])
        hubs = some[: np.searchsorted(some, len(self.rest_at))]
        if len(hubs):
            size = self.rest_size[hubs]
            ends = np.cumsum(size)
            arcs = np.repeat(self.rest_at[hubs] - ends + size, size) + np.arange(ends[-1])
            found[: len(hubs)] |= np.bitwise_or.reduceat(front[self.rest[arcs]], ends - size, axis=0)
        if at is not None:
            out[at] = found
        return out

    def _next_to(self, active: np.ndarray) -> np.ndarray:
        """The nodes with a neighbour among active ones, all where these are many; in order."""
        if len(active) > SOME * self.n:
            return np.arange(self.n)
        mark = np.zeros(self.n, bool)
        for to in self.columns:
            some = active[: np.searchsorted(active, len(to))]
            if not len(some):
                break
            mark[to[some]] = True
        for i in active[: np.searchsorted(active, len(self.rest_at))].tolist():
            mark[self.rest[self.rest_at[i] : self.rest_at[i] + self.rest_size[i]]] = True
        return np.flatnonzero(mark)


def lanes(nodes: int) -> int:
    return 4 * LANES if nodes * LANES <= 2 * LANE_BYTES else LANES


def held(edges: DataFrame, *more: str):
    """The edges (u, v) of a graph for all tasks, 4 bytes an end and 8 for each further column, as the arguments of Adjacency."""
    low, high = edges.agg(F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))).first()
    kind = "int" if low is None or low >= -(1 << 31) and high < 1 << 31 else "long"
    table = edges.select(F.col("u").cast(kind), F.col("v").cast(kind), *more).toArrow()
    a, b, *values = (table.column(i).to_numpy() for i in range(2 + len(more)))
    del table
    pa.default_memory_pool().release_unused()
    ids = np.union1d(np.unique(a), np.unique(b)).astype(np.int64)
    m, step = len(a), 1 << 20
    key = np.empty(2 * m, np.int64)
    for i in range(0, m, step):  # in steps, as the driver holds all edges of the graph
        x, y = np.searchsorted(ids, a[i : i + step]), np.searchsorted(ids, b[i : i + step])
        key[i : i + len(x)], key[m + i : m + i + len(x)] = x << 32 | y, y << 32 | x
    del a, b
    columns = {}
    if more:
        order = np.argsort(key)
        key, columns = key[order], {c: np.concatenate([x, x])[order] for c, x in zip(more, values, strict=True)}
        del order, values
    else:
        key.sort()
    to = np.empty(2 * m, np.int32)
    for i in range(0, 2 * m, step):
        to[i : i + step] = key[i : i + step] & 0xFFFFFFFF
    at = np.searchsorted(key, np.arange(len(ids) + 1) << 32)
    del key
    return edges.sparkSession.sparkContext.broadcast((ids, at, to, columns))


def spread_range(spark: SparkSession, n: int, least: int = 1) -> DataFrame:
    """0 to n - 1 as id, dealt evenly over tasks of at least so many."""
    return spark.range(0, n, 1, max(1, min(-(-n // least), 4 * spark.sparkContext.defaultParallelism)))


def component_labels(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of each node the least node of its component, in compressed rows without empty ones: labels go to neighbours and
    to the node that was the label before, and are followed to their ends, until nothing moves."""
    label = np.arange(len(at) - 1)
    while len(label):
        least = np.minimum(label, np.minimum.reduceat(label[to], at[:-1]))
        new = least.copy()
        np.minimum.at(new, label, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def distance_histogram(edges: DataFrame, with_self: bool = False, largest: bool = False, graph=None) -> DataFrame:
    """(d, cnt) over ordered pairs with a path; with largest, those of the largest component alone, the one of the least id on
    ties. graph: as held gives it, if it is held."""
    if graph is None:
        edges = cut_lineage(edges.select("u", "v"))
        if edges.count() > BROADCAST_EDGES:
            return _frontier_histogram(cut_lineage(largest_component(edges)) if largest else edges, with_self)
        graph = held(edges)
    n, start = len(graph.value[0]), None
    if largest and n:
        label = component_labels(*graph.value[1:3])
        best = np.bincount(label).argmax()
        n = int((label == best).sum())
        start = edges.sparkSession.sparkContext.broadcast(np.flatnonzero(label == best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = None, {}
        for b in batches:
            if search is None:
                search = Search(Adjacency(*graph.value))
                if getattr(graph, "_path", None):  # the next task reads the file again; a search needs no more of it
                    graph.__dict__.pop("_value", None)
            sources, many = b.column(0).to_numpy(), lanes(search.n)
            sources = sources if start is None else start.value[sources]
            for i in range(0, len(sources), many):
                for d, _ in enumerate(search.levels(sources[i : i + many])):
                    total[d] = total.get(d, 0) + search.count
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["d", "cnt"])

    h = spread_range(edges.sparkSession, n, lanes(n)).mapInArrow(run, "d long, cnt long").groupBy("d").agg(F.sum("cnt").alias("cnt"))
    return h if with_self else h.where("d > 0")


def _frontier_histogram(edges: DataFrame, with_self: bool) -> DataFrame:
    h = _frontier_distances(edges, structure.vertices(edges)).groupBy("d").agg(F.count("*").alias("cnt"))
    return h if with_self else h.where("d > 0")


def _frontier_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, at, d) for all sources (id), a join a step, for graphs of any size."""
    s = cut_lineage(structure.symmetric(edges))
    reached = cut_lineage(sources.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("d")))
    front, d = reached, 0
    while True:
        d += 1
        new = front.join(s, F.col("at") == F.col("src")).select("id", F.col("dst").alias("at")).distinct().join(reached, ["id", "at"], "left_anti").withColumn("d", F.lit(d).cast("long"))
        front = cut_lineage(new)
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)


def path_summary(edges: DataFrame) -> DataFrame:
    """Diameter and average path of the largest component."""
    h = distance_histogram(edges, largest=True)
    return h.agg(F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("diameter"), F.coalesce(F.sum(F.col("d") * F.col("cnt")) / F.sum("cnt"), F.lit(0.0)).alias("avg_shortest_path"))


UNREACHABLE = 3.0


def pair_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (u, v). Adds distance: steps from u to v, UNREACHABLE where there is no path or no such node."""
    edges = cut_lineage(edges.select("u", "v"))
    if edges.count() > BROADCAST_EDGES:
        far = _frontier_distances(edges, pairs.select(F.col("u").alias("id")).distinct()).select(F.col("id").alias("u"), F.col("at").alias("v"), "d")
        return pairs.join(far, ["u", "v"], "left").select("u", "v", F.coalesce(F.col("d").cast("double"), F.lit(UNREACHABLE)).alias("distance"))
    graph = held(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, search = None, None
        for b in batches:
            own = own or Adjacency(*graph.value)
            search = search or Search(own)
            u, v = (own.places(b.column(i).to_numpy()) for i in range(2))
            out = np.full(len(u), UNREACHABLE)
            asked = np.flatnonzero((u >= 0) & (v >= 0))
            sources, lane = np.unique(u[asked], return_inverse=True)
            many = lanes(search.n)
            for i in range(0, len(sources), many):
                here = np.flatnonzero((lane >= i) & (lane < i + many))
                left, k = asked[here], lane[here] - i
                for d, front in enumerate(search.levels(sources[i : i + many])):
                    found = front[search.rank[v[left]], k // 64] >> (k % 64).astype(np.uint64) & np.uint64(1) > 0
                    out[left[found]] = d
                    left, k = left[~found], k[~found]
                    if not len(left):
                        break
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["u", "v", "distance"])

    # the pairs of a source together, so that it is searched from once; a set number of tasks, as few bytes are much work
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    rows = pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(tasks, "u").sortWithinPartitions("u")
    return rows.mapInArrow(run, "u long, v long, distance double")


#: Sources whose shares are added side by side (the bits of a word), bytes of neighbours' rows that are met at once, and
#: neighbours of a node at once.
SIDE, MET_BYTES, PIECE = 64, 1 << 20, 1 << 12
#: Numbers of paths up to which they are held in 4 bytes, beyond in 8.
MOST_PATHS = 1e30


class Dependencies:
    """Shares of the shortest paths from each source that pass over each edge (Brandes), SIDE sources side by side. Nodes stand
    in order of their degree, so that those of one degree are a block, and their neighbours' rows are summed at once. The rows
    of a step hold a number where the node has the step's distance from the source, 0 elsewhere; a step meets only nodes that
    have its distance from some source. Sums over sources are held in 8 bytes."""

    def __init__(self, graph: Adjacency):
        self.graph, self.search = graph, Search(graph)
        self.order = np.argsort(self.search.rank)
        deg = graph.deg[self.order]
        self.to = self.search.rank[graph.to[graph.reach(self.order)[0]]].astype(np.int32)
        first, ends = np.flatnonzero(np.diff(deg, prepend=-1)), np.cumsum(deg)
        self.blocks = [(int(i), int(j), int(deg[i]), int(ends[i] - deg[i])) for i, j in zip(first, [*first[1:], len(deg)], strict=True)]
        self.flow = np.zeros(len(self.to))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two ends of each edge, the lower first, and what passed over it, both ways together."""
        a, b = np.repeat(self.order, self.graph.deg[self.order]), self.order[self.to]
        back = np.argsort(np.minimum(a, b) << 32 | np.maximum(a, b), kind="stable").reshape(-1, 2)
        a, b, flow = a[back[:, 0]], b[back[:, 0]], self.flow[back].sum(1)
        own = a != b
        return np.minimum(a, b)[own], np.maximum(a, b)[own], flow[own]

    def add(self, sources: np.ndarray) -> None:
        many = LANES if self.search.n <= 1 << 18 else SIDE
        for i in range(0, len(sources), many):
            own = sources[i : i + many]
            planes, nodes = [], [[] for _ in range(0, len(own), SIDE)]
            for d, front in enumerate(self.search.levels(own)):
                if (d + 1) >> len(planes):
                    planes.append(np.zeros_like(front))
                for k, plane in enumerate(planes):  # the distances and 1, a bit of them in each plane
                    if (d + 1) >> k & 1:
                        plane |= front
                for s, met in enumerate(nodes):
                    met.append(np.flatnonzero(front[:, s]).astype(np.int32))
            for s, met in enumerate(nodes):
                side = own[s * SIDE : (s + 1) * SIDE]
                level = np.zeros((self.search.n, len(side)), np.uint8 if len(planes) <= 8 else np.int32)
                for k, plane in enumerate(planes):
                    bits = np.ascontiguousarray(plane[:, s]).view(np.uint8).reshape(-1, SIDE // 8)
                    level |= np.unpackbits(bits, axis=1, count=len(side), bitorder="little").astype(level.dtype) << k
                met = [x for x in met if len(x)]
                if not self._add(side, level, met, np.float32):
                    self._add(side, level, met, np.float64)

    def _blocks(self, nodes: np.ndarray, width: int):
        """For nodes in order, chunk by chunk: the nodes (a slice where they are all of their block), their places in the
        block, its degree, and the arcs of the block."""
        for i, j, size, at in self.blocks:
            x, y = np.searchsorted(nodes, (i, j)).tolist()
            many, whole = max(1, MET_BYTES // (4 * width * min(size, PIECE))), y - x == j - i
            for k in range(x, y, many):
                e = min(k + many, y)
                own = slice(i + k - x, i + e - x) if whole else nodes[k:e]
                yield own, slice(k - x, e - x) if whole else own - i, size, slice(at, at + (j - i) * size)

    def _met(self, rows: np.ndarray, to: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The rows of neighbours to, [node, neighbour, source]."""
        out = held[: to.size]
        np.take(rows, to.reshape(-1), axis=0, out=out, mode="clip")
        return out.reshape(*to.shape, rows.shape[1])

    def _add(self, sources: np.ndarray, level: np.ndarray, nodes: list[np.ndarray], kind: type) -> bool:
        """False, and nothing added, if there are more paths than numbers of 4 bytes should count."""
        width = level.shape[1]
        paths, now, then = (np.zeros(level.shape, kind) for _ in range(3))
        held = np.empty((max(MET_BYTES // (4 * width), PIECE), width), kind)
        ones = np.ones((1, PIECE), kind)
        start, lane = self.search.rank[sources], np.arange(len(sources))
        paths[start, lane] = now[start, lane] = 1
        for d in range(1, len(nodes)):
            most = 0
            for own, at, size, arcs in self._blocks(nodes[d], width):
                to, new = self.to[arcs].reshape(-1, size)[at], 0
                for k in range(0, size, PIECE):
                    met = self._met(now, to[:, k : k + PIECE], held)
                    new = new + np.matmul(ones[:, : met.shape[1]], met)[:, 0]
                new *= level[own] == d + 1
                then[own] = new
                paths[own] += new
                most = max(most, float(new.max()))
            if kind is np.float32 and most > MOST_PATHS:
                return False
            now[nodes[d - 1]] = 0
            now, then = then, now
        now[nodes[-1]] = 0
        last = level[nodes[-1]] == len(nodes)
        now[nodes[-1]] = last / np.maximum(paths[nodes[-1]], 1)
        for d in range(len(nodes) - 2, -1, -1):
            for own, at, size, arcs in self._blocks(nodes[d], width):
                to, flow, new = self.to[arcs].reshape(-1, size)[at], self.flow[arcs].reshape(-1, size), 0
                here, own_paths = level[own] == d + 1, paths[own]
                ways = (own_paths * here)[:, :, None]
                for k in range(0, size, PIECE):
                    met = self._met(now, to[:, k : k + PIECE], held)
                    new = new + np.matmul(ones[:, : met.shape[1]], met)[:, 0]
                    flow[at, k : k + PIECE] += np.matmul(met, ways)[:, :, 0]
                new += 1 / np.maximum(own_paths, 1)
                new *= here
                then[own] = new
            now[nodes[d + 1]] = 0
            now, then = then, now
        return True


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(u, v, betweenness): share of all pairs of nodes whose shortest paths pass over the edge. For a graph of up to
    BROADCAST_EDGES edges; with sources (id), from those alone, scaled to all nodes."""
    edges = cut_lineage(edges.select("u", "v"))
    if edges.count() > BROADCAST_EDGES:
        raise ValueError("the graph is too large to be held by a task; take a part of it")
    graph, spark = held(edges), edges.sparkSession
    n, tasks = len(graph.value[0]), 2 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Adjacency(*graph.value), None
        for b in batches:
            places = own.places(b.column(0).to_numpy())
            sums = sums or Dependencies(own)
            sums.add(places[places >= 0])
        u, v, flow = sums.edges() if sums else (np.zeros(0, np.int64),) * 3
        for i in range(0, len(u), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[u[j]]), pa.array(own.ids[v[j]]), pa.array(flow[j])], ["u", "v", "f"])

    # a set number of tasks, as few bytes are much work
    start = cut_lineage((structure.vertices(edges) if sources is None else sources.select("id")).select(F.col("id").cast("long")))
    k = start.join(structure.vertices(edges), "id", "left_semi").count()
    sums = start.repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(run, "u long, v long, f double").groupBy("u", "v").agg(F.sum("f").alias("f"))
    # each pair of nodes is met from both of its ends
    return sums.select("u", "v", (F.col("f") / max(1, k) * n / max(1, n * (n - 1))).alias("betweenness"))
