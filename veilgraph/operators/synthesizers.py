"""Private graph synthesizers: edges -> edges, registered by name.

Pairs outside the graph are never enumerated: fills draw endpoints by number, drop what exists and rank by number.
Each takes (edges over ids 0..n-1, n, epsilon) and returns edges(u, v).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import laplace, uniform
from ..functions.noise import draw
from ..session import cut_lineage
from . import community, influence, mechanisms, structure

REGISTRY: dict[str, Callable] = {}


def register(name: str):
    def put(f):
        REGISTRY[name] = f
        return f

    return put


def compact(edges: DataFrame) -> tuple[DataFrame, int]:
    """Ids become 0..n-1 in order."""
    edges = cut_lineage(edges)  # both joins and the ids read them
    idx = cut_lineage(structure.relabelled(edges))
    e = edges.join(idx.select(F.col("id").alias("u"), F.col("idx").alias("a")), "u").join(idx.select(F.col("id").alias("v"), F.col("idx").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return cut_lineage(e), idx.count()


def fill(spark, n: int, k: int, without: DataFrame, draws: int | None = None, first: int = 2, second: int = 3) -> DataFrame:
    """k pairs by draw number, none twice, none of those in without."""
    if k <= 0 or n < 2:
        return without.limit(0)
    rows = spark.range(draws or 2 * k + 100).select("id", (draw(F.col("id"), first) % n).alias("a"), (draw(F.col("id"), second) % n).alias("b"))
    pairs = rows.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("id").alias("id"))
    return pairs.join(without, ["u", "v"], "left_anti").orderBy("id").limit(k).select("u", "v")


def tmf_threshold(n: int, m_noisy: float, eps1: float) -> float:
    """Two branches; the second in log space, so that it holds for any budget."""
    cells = n * (n - 1) / 2
    limit = math.log(max(cells / m_noisy - 1, 1e-12)) if m_noisy > 0 else math.inf
    if eps1 < limit:
        return limit / (2 * eps1)
    a, b = math.log(cells / (2 * m_noisy) - 0.5) if cells > m_noisy else -math.inf, eps1 + math.log(0.5)
    top = max(a, b)
    return (top + math.log(math.exp(a - top) + math.exp(b - top))) / eps1


def tmf_parts(edges: DataFrame, n: int, epsilon: float) -> tuple[DataFrame, float, float]:
    """Edges that stay, the noisy edge count, the threshold."""
    spark, eps = edges.sparkSession, epsilon / 2
    m = edges.count()
    noisy = max(0.0, spark.range(1).select((F.lit(float(m)) + laplace(uniform(F.lit(1), 900), 1 / eps)).alias("x")).first().x)
    theta = tmf_threshold(n, noisy, eps)
    kept = edges.where(F.greatest(1.0 + laplace(uniform(F.col("u") * 2000003 + F.col("v"), 1), 1 / eps), F.lit(0.0)) > theta)
    return kept, noisy, theta


@register("tmf")
def tmf(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    kept, noisy, _ = tmf_parts(edges, n, epsilon)
    kept = cut_lineage(kept)
    return kept.unionByName(fill(edges.sparkSession, n, math.ceil(noisy - kept.count()), kept))


@register("fallback")
def fallback(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """A share of the true edges by band of epsilon; callers mark its rows as a fallback."""
    share = 0.1 if epsilon < 0.1 else 0.3 if epsilon < 1 else 0.6 if epsilon < 10 else 0.9
    from .sampling import edge_key, first_by_draw

    return first_by_draw(edges, edge_key(), 71, int(edges.count() * share))


def drawn_in_blocks(blocks: DataFrame, u: Callable, v: Callable, stream: int) -> DataFrame:
    """blocks: (block, k, pairs, ...). Up to k distinct pairs a block, no more than it has: the first by number of 4k + 16
    draws; u and v make an end of a draw in [0, P)."""
    rows = blocks.where("k > 0 AND pairs > 0").withColumn("k", F.least("k", "pairs")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), 4 * F.col("k") + 16)))
    key = F.col("block") * 1009 + F.col("i") * 48611
    rows = rows.withColumn("a", u(draw(key, stream))).withColumn("b", v(draw(key, stream + 1))).where("a <> b")
    pairs = rows.groupBy("block", "k", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("i").alias("i"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("i"))
    return pairs.withColumn("r", nth).where("r <= k").select("u", "v")


@register("hrg")
def hrg(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Dendrogram of id prefixes: an edge belongs to the block of its ends' common prefix. Every block, empty or not, gets a
    noisy count (an edge is in one block, so the budget is spent once), and so many pairs are drawn in it."""
    each = hrg_noisy(edges, n, epsilon).withColumn("block", F.col("prefix") * 64 + F.col("level"))
    half = F.pow(F.lit(2.0), F.col("level")).cast("long")
    base = F.col("prefix") * 2 * half
    return drawn_in_blocks(each, lambda d: base + d % half, lambda d: base + half + d % F.floor(F.col("pairs") / half), 42)


def hrg_noisy(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(level, prefix, pairs, k): all inner nodes of the dendrogram of n leaves with noisy counts."""
    levels = max(1, math.ceil(math.log2(max(n, 2))))
    rows = edges.sparkSession.range(levels).select(F.col("id").alias("level"))
    half = F.pow(F.lit(2.0), F.col("level")).cast("long")
    # a node holds a leaf on each side
    rows = rows.withColumn("prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(n - 1) - half) / (2 * half)).cast("long")))) if n > 1 else rows.limit(0).withColumn("prefix", F.lit(0).cast("long"))
    rows = rows.where("prefix >= 0").withColumn("pairs", half * F.least(half, F.lit(n) - (F.col("prefix") * 2 + 1) * half)).where("pairs > 0")
    rows = rows.join(hrg_blocks(edges, n).select("level", "prefix", "cnt"), ["level", "prefix"], "left")
    noisy = F.coalesce("cnt", F.lit(0)) + laplace(uniform(F.col("prefix") * 64 + F.col("level"), 41), 1 / epsilon)
    return rows.select("level", "prefix", "pairs", F.least(F.greatest(F.bround(noisy), F.lit(0.0)).cast("long"), F.col("pairs")).alias("k"))


def hrg_blocks(edges: DataFrame, n: int) -> DataFrame:
    """(level, prefix, cnt, pairs, prob): inner nodes of the dendrogram over id bits that hold an edge."""
    level = F.floor(F.log2(F.col("u").bitwiseXOR(F.col("v")).cast("double"))).cast("long")
    e = edges.select(level.alias("level"), "u").select("level", F.floor(F.col("u") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("long").alias("prefix"))
    half = F.pow(F.lit(2.0), F.col("level")).cast("long")
    right = F.least(half, F.lit(n) - (F.col("prefix") * 2 + 1) * half)
    return e.groupBy("level", "prefix").agg(F.count("*").alias("cnt")).withColumn("pairs", half * right).withColumn("prob", F.col("cnt") / F.col("pairs"))


@register("privgraph")
def privgraph(edges: DataFrame, n: int, epsilon: float, communities: int = 16) -> DataFrame:
    """A third of the budget finds communities (the exponential mechanism, from blocks by id), a third counts the edges between
    them, a third the degrees inside; pairs are drawn evenly between communities and by degree inside."""
    e1, e2, e3 = mechanisms.budget_shares(epsilon, 3)
    labels = cut_lineage(community.exponential_moves(edges, structure.padded_nodes(edges, n).select("id", (F.col("id") % communities).alias("com")), e1))
    return privgraph_from(edges, labels, e2, e3, communities)


def privgraph_between(edges: DataFrame, labels: DataFrame, epsilon: float, communities: int) -> DataFrame:
    """(c1, c2, cnt, k): counts and noisy counts of all pairs c1 < c2 of communities."""
    blocks = community.quotient_graph(edges, labels).select("c1", "c2", F.col("weight").alias("cnt")).where("c1 < c2")
    cells = influence.upper_cells(blocks, communities).select(F.col("i").alias("c1"), F.col("j").alias("c2"), "cnt")
    return cells.withColumn("k", F.greatest(F.bround(F.col("cnt") + laplace(uniform(F.col("c1") * 2003 + F.col("c2"), 51), 1 / epsilon)), F.lit(0.0)).cast("long"))


def privgraph_inside(edges: DataFrame, labels: DataFrame, epsilon: float) -> DataFrame:
    """(id, com, deg, k): neighbours in the own community, and their noisy number (an edge is in two degrees)."""
    ends = edges.join(labels.select(F.col("id").alias("u"), F.col("com").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("com").alias("cv")), "v").where("cu = cv").select("u", "v")
    deg = labels.join(structure.degrees(ends), "id", "left").select("id", "com", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
    return deg.withColumn("k", F.greatest(F.bround(F.col("deg") + laplace(uniform(F.col("id"), 55), 2 / epsilon)), F.lit(0.0)).cast("long"))


def privgraph_from(edges: DataFrame, labels: DataFrame, e2: float, e3: float, communities: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("com").orderBy("id")) - 1
    places = cut_lineage(labels.withColumn("place", order.cast("long")))
    size = places.groupBy("com").agg(F.count("*").alias("size"))
    between = cut_lineage(privgraph_between(edges, labels, e2, communities)).join(F.broadcast(size.select(F.col("com").alias("c1"), F.col("size").alias("s1"))), "c1").join(F.broadcast(size.select(F.col("com").alias("c2"), F.col("size").alias("s2"))), "c2")
    # ends are drawn as (community, place), which a number tells apart
    drawn = drawn_in_blocks(between.withColumn("block", F.col("c1") * communities + F.col("c2")).withColumn("pairs", F.col("s1") * F.col("s2")), lambda d: F.col("c1") * TOP_PLACE + d % F.col("s1"), lambda d: F.col("c2") * TOP_PLACE + d % F.col("s2"), 52)
    ids = places.select((F.col("com") * TOP_PLACE + F.col("place")).alias("at"), "id")
    outer = drawn.join(ids.select(F.col("at").alias("u"), F.col("id").alias("a")), "u").join(ids.select(F.col("at").alias("v"), F.col("id").alias("b")), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return outer.unionByName(matched_stubs(privgraph_inside(edges, labels, e3).select("id", "com", "k"), "com", 56)).distinct()


TOP_PLACE = 1 << 40


def matched_stubs(nodes: DataFrame, group: str, stream: int) -> DataFrame:
    """nodes: (id, group, k). Each node has k stubs; stubs of a group are ordered by draw and joined two by two. Loops and
    repeated pairs go, as they do in the model."""
    stubs = nodes.where("k > 0").select("id", F.col(group).alias("g"), F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("i"))
    stubs = structure.ranked(stubs.withColumn("place", F.struct("g", draw(F.col("id") * 1009 + F.col("i"), stream).alias("d"), "id", "i")), "place")
    first = stubs.groupBy("g").agg(F.min("idx").alias("first"))
    pairs = stubs.join(F.broadcast(first), "g").groupBy("g", F.floor((F.col("idx") - F.col("first")) / 2).alias("pair")).agg(F.min("id").alias("u"), F.max("id").alias("v"))
    return pairs.where("u < v").select("u", "v").distinct()


def privgraph_blocks(edges: DataFrame, communities: int = 16) -> DataFrame:
    return edges.groupBy(F.least(F.col("u") % communities, F.col("v") % communities).alias("c1"), F.greatest(F.col("u") % communities, F.col("v") % communities).alias("c2")).agg(F.count("*").alias("cnt"))


def havel_hakimi(degrees: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of a graph with (close to) the degrees, by a heap: the node of the highest degree is joined to the next ones. What
    a sequence can't have is left out: shortfall() tells how much."""
    heap = [(-d, i) for i, d in degrees if d > 0]
    heapq.heapify(heap)
    out = []
    while heap:
        d, i = heapq.heappop(heap)
        near = [heapq.heappop(heap) for _ in range(min(-d, len(heap)))]
        for e, j in near:
            out.append((min(i, j), max(i, j)))
            if e < -1:
                heapq.heappush(heap, (e + 1, j))
    return out


def shortfall(degrees: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees: (id, deg) that were asked for. One row: stubs asked for, and stubs that found no partner."""
    return degrees.agg(F.coalesce(F.sum("deg"), F.lit(0)).alias("asked")).crossJoin(edges.agg((2 * F.count("*")).alias("made"))).select("asked", (F.col("asked") - F.col("made")).alias("missing"))


@register("dp1k")
def dp1k(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Noisy degree histogram realised by Havel-Hakimi, in blocks of like degree so that no task holds the whole graph."""
    h = mechanisms.noisy_histogram(edges, epsilon).where("noisy > 0 AND deg > 0")
    nodes = h.select("deg", F.explode(F.sequence(F.lit(1).cast("long"), "noisy")).alias("i"))
    nodes = structure.ranked(nodes.withColumn("key", F.col("deg") * 10_000_000_000 + F.col("i")), "key").select(F.col("idx").alias("id"), "deg")
    nodes = nodes.withColumn("block", draw(F.col("id"), 61) % max(1, n // 5000))

    def realise(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(havel_hakimi(list(zip(pdf["id"].tolist(), pdf["deg"].tolist(), strict=True))), columns=["u", "v"], dtype="int64")

    return nodes.groupBy("block").applyInPandas(realise, "u long, v long")


@register("bter")
def bter(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Blocks of d + 1 nodes of like noisy degree, edges inside with a chance that grows with the block, Chung-Lu for the rest."""
    deg = mechanisms.even_total(mechanisms.noisy_degrees(edges, epsilon)).where("noisy > 0")
    blocks = bter_blocks(deg)
    top = blocks.agg(F.max("noisy")).first()[0] or 1
    a, b = blocks.select("block", F.col("id").alias("u"), "size"), blocks.select("block", F.col("id").alias("v"))
    inside = a.join(b, "block").where("u < v").where(uniform(F.col("u") * 2000003 + F.col("v"), 62) < F.ln(F.col("size") + 1) / math.log(top + 1 if top > 0 else 2)).select("u", "v")
    inside = cut_lineage(inside)
    used = structure.degrees(inside).withColumnRenamed("deg", "used")
    stubs = deg.join(used, "id", "left").select("id", F.lit(0).alias("g"), (F.col("noisy") - F.coalesce("used", F.lit(0))).alias("k"))
    return inside.unionByName(matched_stubs(stubs, "g", 63)).distinct()


def bter_blocks(degrees: DataFrame) -> DataFrame:
    """(id, noisy, block, size): nodes of one degree d in runs of d + 1 by id."""
    rank = F.row_number().over(Window.partitionBy("noisy").orderBy("id")) - 1
    rows = degrees.withColumn("run", F.floor(rank / (F.col("noisy") + 1))).withColumn("block", F.col("noisy") * 1_000_000_000 + F.col("run"))
    return rows.select("id", "noisy", "block", (F.col("noisy") + 1).alias("size"))


def skg_moments(edges: DataFrame, epsilon: float) -> DataFrame:
    """(d, h, triangle_count): sums over noisy degrees, and a noisy number of triangles by smooth sensitivity, half of the
    budget each. d and h use the degrees after a non-decreasing fit over their ranks' values."""
    noisy = mechanisms.noisy_degrees(edges, epsilon / 2, 82)
    k = F.col("noisy")
    s = noisy.agg(F.coalesce(F.sum(k), F.lit(0)).alias("d"), F.coalesce(F.sum(k * (k - 1)), F.lit(0)).alias("h"))
    scale = 2 * mechanisms.smooth_sensitivity(edges, epsilon / 20).first().smooth / (epsilon / 2)
    t = structure.triangle_count(edges).select(F.greatest(F.bround(F.col("triangle_count") + laplace(uniform(F.lit(1), 83), scale)), F.lit(0.0)).cast("long").alias("triangle_count"))
    return s.crossJoin(t)


def skg_grid(edges: DataFrame, n: int, epsilon: float, steps: int = 10) -> DataFrame:
    """Initiator (a, b, c) of a stochastic Kronecker graph from noisy numbers of edges, hairpins and triangles, on a grid."""
    k = max(1, math.ceil(math.log2(max(n, 2))))
    moments = cut_lineage(skg_moments(edges, epsilon))
    s, t = moments.select("d", "h"), moments.select("triangle_count")
    g = edges.sparkSession.range(steps + 1).select((F.col("id") / float(steps)).alias("x"))
    grid = g.select(F.col("x").alias("a")).join(g.select(F.col("x").alias("b")), F.col("b") <= F.col("a")).join(g.select(F.col("x").alias("c")), F.col("c") <= F.col("a"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    p = lambda x: F.pow(x, F.lit(float(k)))
    e_hat = (p(a + 2 * b + c) - p(a + c)) / 2
    h_hat = (p((a + b) * (a + b) + (b + c) * (b + c)) - 2 * p(a * (a + b) + c * (c + b)) - p(a * a + 2 * b * b + c * c) + 2 * p(a * a + c * c)) / 2
    t_hat = (p(a * a * a + 3 * b * b * (a + c) + c * c * c) - 3 * p(a * (a * a + b * b) + c * (b * b + c * c)) + 2 * p(a * a * a + c * c * c)) / 6
    err = lambda real, fit: F.pow((real - fit) / F.greatest(real, F.lit(1.0)), F.lit(2.0))
    rows = grid.join(F.broadcast(s), F.lit(True)).join(F.broadcast(t), F.lit(True))
    return rows.select("a", "b", "c", F.round(err(F.col("d") / 2, e_hat) + err(F.col("h") / 2, h_hat) + err(F.col("triangle_count"), t_hat), 9).alias("loss"))


def rmat(spark, k: int, n: int, edges: int, a: float, b: float, c: float, over: int = 3) -> DataFrame:
    """The first `edges` distinct pairs below n of recursive quadrant draws, of so many times as many draws."""
    total = a + 2 * b + c
    if total <= 0:
        raise ValueError("the initiator is empty")
    u = v = F.lit(0).cast("long")
    for level in range(k):
        x = uniform(F.col("id") * 64 + level, 81)
        row, col = x >= (a + b) / total, ((x >= a / total) & (x < (a + b) / total)) | (x >= (a + 2 * b) / total)
        u, v = u * 2 + row.cast("long"), v * 2 + col.cast("long")
    rows = spark.range(over * edges + 100).select("id", u.alias("a"), v.alias("b")).where(f"a <> b AND a < {n} AND b < {n}")
    return rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("id").alias("id")).orderBy("id").limit(edges).select("u", "v")


@register("skg")
def skg(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    best = skg_grid(edges, n, epsilon).where("a + b + c > 0").orderBy("loss", "a", "b", "c").first()
    m = max(0, round(skg_moments(edges, epsilon).first().d / 2))
    out, over = None, 3
    for _ in range(4):  # a skewed initiator meets the same pairs again and again
        out = cut_lineage(rmat(edges.sparkSession, max(1, math.ceil(math.log2(max(n, 2)))), n, m, best.a, best.b, best.c, over))
        if out.count() >= m:
            break
        over *= 4
    return out


@register("privdpr")
def privdpr(edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """PageRank-shaped graph: a noisy number of edges with half of the budget, scores by power iteration with noise from the
    other half (for scores that one edge changes by 1 / n at most), endpoints drawn in proportion to them."""
    noisy = cut_lineage(privdpr_scores(edges, n, epsilon / 2))
    m = max(0, round(edges.count() + edges.sparkSession.range(1).select(laplace(uniform(F.lit(2), 93), 2 / epsilon).alias("x")).first().x))
    total = noisy.agg(F.sum("r")).first()[0] or 1.0
    # a fifth more stubs than ends, since loops and repeated pairs go; the first m pairs by draw stay
    stubs = noisy.select("id", F.lit(0).alias("g"), F.ceil(F.col("r") / total * 2.4 * m).cast("long").alias("k"))
    pairs = matched_stubs(stubs, "g", 92)
    return pairs.orderBy(draw(F.col("u") * 2000003 + F.col("v"), 94), "u", "v").limit(m)


def privdpr_scores(edges: DataFrame, n: int, epsilon: float, steps: int = 10) -> DataFrame:
    """(id, r): noisy PageRank, above 0."""
    s = cut_lineage(structure.symmetric(edges))
    deg = cut_lineage(structure.degrees(edges))
    rank = deg.select("id", F.lit(1.0 / max(n, 1)).alias("r"))
    for _ in range(steps):
        share = rank.join(deg, "id").select(F.col("id").alias("src"), (F.col("r") / F.col("deg")).alias("x"))
        rank = cut_lineage(s.join(share, "src").groupBy(F.col("dst").alias("id")).agg((F.lit(0.15 / max(n, 1)) + 0.85 * F.sum("x")).alias("r")))
    return rank.select("id", F.greatest(F.col("r") + laplace(uniform(F.col("id"), 91), 1.0 / (epsilon * max(n, 1))), F.lit(1e-12)).alias("r"))


def generate(edges: DataFrame, n: int, epsilon: float, method: str) -> DataFrame:
    """The synthetic graph of the method; a failure is raised."""
    return cut_lineage(REGISTRY[method](edges, n, epsilon))


def synthesize(edges: DataFrame, n: int, epsilon: float, method: str) -> tuple[DataFrame, bool]:
    """The synthetic graph, and whether it is the fallback: for a graph that the method can't fit. Other failures are raised.
    For tables that mark the rows of a fallback; others call generate."""
    try:
        return generate(edges, n, epsilon, method), False
    except (ValueError, ArithmeticError):
        return cut_lineage(fallback(edges, n, epsilon)), True
