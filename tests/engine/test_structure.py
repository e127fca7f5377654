import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilgraph.operators import compare, community, mechanisms, paths, structure, synthesizers
from veilgraph.sources import edge_lists, read_edges, read_weighted_edges, transition_degrees, user_transitions, write_edges

#: A graph of 7 nodes and 9 edges whose measures are known.
SMALL = [(0, 1), (0, 2), (0, 4), (0, 5), (0, 7), (1, 3), (1, 5), (2, 5), (3, 7)]


def graph(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "u long, v long")


def one(df):
    return df.first().asDict()


def test_known_values(spark):
    e = graph(spark, SMALL)
    assert one(structure.graph_size(e)) == {"node_count": 7, "edge_count": 9}
    s = one(structure.degree_stats(e))
    assert s["avg_degree"] == pytest.approx(2.571429, abs=1e-6) and s["degree_variance"] == pytest.approx(1.387755, abs=1e-6) and s["degree_variance_sample"] == pytest.approx(1.619048, abs=1e-6)
    assert structure.triangle_count(e).first()[0] == 2
    c = one(structure.clustering_summary(e))
    assert c["transitivity"] == pytest.approx(0.315789, abs=1e-6) and c["avg_clustering"] == pytest.approx(0.314286, abs=1e-6)
    assert structure.assortativity(e).first()[0] == pytest.approx(-0.477612, abs=1e-6)
    labels = structure.vertices(e).selectExpr("id", "id % 3 AS com")
    assert community.modularity(e, labels).first()[0] == pytest.approx(-0.228395, abs=1e-6)
    assert {r.d: r.cnt for r in paths.distance_histogram(e).collect()} == {1: 18, 2: 20, 3: 4}
    assert one(paths.path_summary(e)) == {"diameter": 3, "avg_shortest_path": pytest.approx(1.666667, abs=1e-6)}
    assert dict(structure.core_numbers(e).collect()) == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 2, 7: 2}
    ev = {r.id: r.centrality for r in community.eigenvector_centrality(e, 60).collect()}
    assert ev[0] == pytest.approx(0.571083, abs=1e-4) and ev[4] == pytest.approx(0.192886, abs=1e-4)
    n = {r.id: r for r in structure.node_features(e).collect()}
    assert n[5].second_neighbor_count == 6 and n[1].neighbor_avg_degree == pytest.approx(3.3333, abs=1e-4) and n[0].local_density == pytest.approx(0.4667, abs=1e-4)
    j = {(r.u, r.v): (r.common_neighbors, round(r.jaccard, 4), r.preferential_attachment) for r in structure.edge_features(e).collect()}
    assert j[0, 5] == (2, 0.3333, 15) and j[3, 7] == (0, 0.0, 4)


@pytest.mark.parametrize("n", [3, 5, 6])
def test_complete_graphs(spark, n):
    e = graph(spark, [(i, j) for i in range(n) for j in range(i)])
    assert structure.triangle_count(e).first()[0] == math.comb(n, 3)
    assert structure.clustering_summary(e).first().transitivity == 1.0
    assert structure.assortativity(e).first()[0] is None
    assert paths.path_summary(e).first().diameter == 1


def test_frontier_form_agrees(spark):
    e = graph(spark, [*SMALL, (10, 11), (11, 12)])
    assert sorted(map(tuple, paths._frontier_histogram(e, True).collect())) == sorted(map(tuple, paths.distance_histogram(e, True).collect()))
    assert {r.component for r in paths.connected_components(e).collect()} == {0, 10}


def random_graph(n=300, m=500, hub=180):
    r = random.Random(4)
    return sorted({(min(p), max(p)) for p in [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(0, i) for i in range(1, hub)] if p[0] != p[1]})


def steps(pairs):
    """Distances from each node, one search a node."""
    near = defaultdict(set)
    for u, v in pairs:
        near[u].add(v)
        near[v].add(u)
    out = {}
    for s in near:
        front, seen, d = {s}, {s: 0}, 0
        while front:
            d += 1
            front = {w for x in front for w in near[x]} - set(seen)
            seen |= dict.fromkeys(front, d)
        out[s] = seen
    return out


def test_searches_side_by_side_agree_with_single_ones(spark):
    """More sources than bits of a batch, and a node with more neighbours than are met one by one."""
    pairs = random_graph()
    e, want = graph(spark, pairs), steps(pairs)
    assert len(want) > paths.LANES and max(Counter(x for p in pairs for x in p).values()) > paths.COLUMNS
    assert {r.d: r.cnt for r in paths.distance_histogram(e, True).collect()} == Counter(d for x in want.values() for d in x.values())
    big = {d: c for d, c in Counter(d for x in want.values() if len(x) > len(want) / 2 for d in x.values()).items() if d}
    assert one(paths.path_summary(e)) == {"diameter": max(big), "avg_shortest_path": pytest.approx(sum(d * c for d, c in big.items()) / sum(big.values()))}
    # the work is dealt over tasks, however few bytes the sources are
    assert paths.spread_range(spark, 10_000, paths.LANES).rdd.getNumPartitions() > 1


def test_pair_distances_of_many_sources(spark):
    pairs = random_graph(400, 300, 90)
    want = steps(pairs)
    asked = [(u, v) for u in range(400) for v in (u, (u * 7 + 1) % 400, 999)]
    got = {(r.u, r.v): r.distance for r in paths.pair_distances(graph(spark, pairs), spark.createDataFrame(asked, "u long, v long")).collect()}
    assert got == {(u, v): float(want.get(u, {}).get(v, paths.UNREACHABLE)) for u, v in asked}


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_held_two_hop_features_agree_with_joins(spark, shift):
    """The held form writes no neighbourhoods; ids need not be small."""
    e = graph(spark, [(u + shift, v + shift) for u, v in [*random_graph(60, 90, 30), (900, 901)]])
    got, want = ({r.id: r for r in f(e).collect()} for f in (structure.two_hop_features, structure._joined_two_hop_features))
    assert set(got) == set(want) and all(list(got[k]) == pytest.approx(list(want[k])) for k in want)
    assert "Join" not in structure.two_hop_features(e)._jdf.queryExecution().executedPlan().toString()
    assert structure.two_hop_features(e.limit(0)).count() == 0


def test_counted_transitions_agree_with_pairs(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    rows = [(r.choice([None, *range(150)]), datetime.datetime(2024, 1, 1, r.randrange(20), r.randrange(60))) for _ in range(600)] + [(500, datetime.datetime(2024, 2, 1)), (3, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    want = user_transitions(spark, str(tmp_path)).groupBy("u").count().collect()
    for size in (64, 1 << 14):
        monkeypatch.setattr(edge_lists, "BLOCK_USERS", size)
        assert sorted(map(tuple, transition_degrees(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def test_empty(spark):
    e = graph(spark, SMALL).limit(0)
    assert one(structure.graph_size(e)) == {"node_count": 0, "edge_count": 0}
    assert structure.degree_stats(e).first().avg_degree == 0.0 and structure.clustering_summary(e).first().transitivity == 0.0
    assert paths.path_summary(e).first().diameter == 0 and compare.ks(structure.degree_histogram(e), structure.degree_histogram(e)).first()[0] == 1.0


def test_identities(spark):
    e = graph(spark, SMALL)
    h = structure.degree_histogram(e)
    assert compare.ks(h, h).first()[0] == 0 and compare.kl(h, h).first()[0] == 0
    labels = structure.vertices(e).selectExpr("id % 2 AS x", "id % 2 AS y")
    assert compare.nmi(labels, "x", "y").first()[0] == pytest.approx(1)
    values = spark.createDataFrame([(x,) for x in (5, -2, 3, 0, -4, 7)], "x long")
    rows = mechanisms.norm_sub(values).collect()
    assert {r["shift"] for r in rows} == {2} and min(r.y for r in rows) == 0
    assert mechanisms.graphical(h).first()[0] == 1


def test_threshold_does_not_overflow():
    assert 0.9 < synthesizers.tmf_threshold(1000, 3000.0, 5000.0) <= 1.0
    assert synthesizers.havel_hakimi([(0, 2), (1, 2), (2, 2)]) == [(0, 1), (0, 2), (1, 2)]


def test_every_synthesizer_makes_a_simple_graph(spark):
    e = graph(spark, [(i, (i * i + 3) % 40) for i in range(40) if i != (i * i + 3) % 40]).distinct()
    real, n = synthesizers.compact(e)
    for name in synthesizers.REGISTRY:
        fake, failed = synthesizers.synthesize(real, n, 5.0, name)
        rows = [tuple(r) for r in fake.collect()]
        assert not failed, name
        assert len(rows) == len(set(rows)) and all(0 <= u < v for u, v in rows), name


def test_edge_lists(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# a graph\n0 1\r\n1\t0\n\n2 2\n1 2 \n")
    assert sorted(map(tuple, read_edges(spark, str(p)).collect())) == [(0, 1), (1, 2), (2, 2)]
    assert sorted(map(tuple, read_edges(spark, str(p), keep_loops=False).collect())) == [(0, 1), (1, 2)]
    p.write_text("0 1\n3\n")
    assert read_edges(spark, str(p)).count() == 0 and read_edges(spark, str(p), strict=False).count() == 1
    p.write_text("0 1 2.5\n1 0\n")
    assert [tuple(r) for r in read_weighted_edges(spark, str(p)).collect()] == [(0, 1, 3.5)]
    write_edges(graph(spark, SMALL), str(tmp_path / "out"))
    assert read_edges(spark, str(tmp_path / "out")).count() == 9


def test_searches_meet_all_nodes_though_steps_pick_them():
    """Long chains with hubs, some of them apart: steps that pick nodes and steps that meet all give the same levels."""
    r = np.random.default_rng(5)
    chain = np.arange(3000)
    a = np.concatenate([chain[:-1], np.full(90, 700), np.full(80, 2900), r.integers(0, 3000, 200), 5000 + chain[:50]])
    b = np.concatenate([chain[1:], r.integers(0, 1500, 90), r.integers(2000, 3000, 80), r.integers(0, 3000, 200), 5001 + chain[:50]])
    pairs = np.unique(np.sort(np.stack([a, b], 1)[a != b], 1), axis=0)
    ids = np.unique(pairs)
    x, y = np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1])
    key = np.sort(np.concatenate([x << 32 | y, y << 32 | x]))
    graph = paths.Adjacency(ids, np.searchsorted(key, np.arange(len(ids) + 1) << 32), (key & 0xFFFFFFFF).astype(np.int32), {})
    search, sources = paths.Search(graph), np.array([0, 699, 1, *range(2890, 2960), len(ids) - 1])
    got = np.full((len(sources), len(ids)), -1)
    for d, front in enumerate(search.levels(sources)):
        bits = np.unpackbits(front.view(np.uint8), axis=1, count=len(sources), bitorder="little")[search.rank].T.astype(bool)
        got[bits] = d
    for k, s in enumerate(sources.tolist()):
        want, front, d = np.full(len(ids), -1), {s}, 0
        while front:
            want[list(front)] = d
            front, d = {j for i in front for j in graph.to[graph.at[i] : graph.at[i + 1]].tolist() if want[j] < 0}, d + 1
        assert got[k].tolist() == want.tolist()
    label = paths.component_labels(graph.at, graph.to)
    assert set(label.tolist()) == {0, int(np.searchsorted(ids, 5000))} and (label == 0).sum() == 3000


def test_the_largest_component_is_measured_without_a_join(spark, monkeypatch):
    """Of two components of one size that of the least id; found in the graph that is held anyway."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (5, 6), (4, 6), (6, 7), (20, 21)], "u long, v long")
    monkeypatch.setattr(paths, "largest_component", lambda e: pytest.fail("joins"))
    got = {r.d: r.cnt for r in paths.distance_histogram(edges, largest=True).collect()}
    assert got == {1: 6, 2: 4, 3: 2}
    assert paths.path_summary(edges).first() == (3, 20 / 12)


def test_rounds_in_one_task_are_those_of_joins(spark, monkeypatch):
    """Communities and centralities of a graph with loops and weights, the same in one task and by joins; without edges none."""
    r = random.Random(4)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(40) + 40 * (i % 3), r.randrange(40) + 40 * (i % 3)) for i in range(260))} | {(3, 50), (60, 100), (500, 500)})
    e = spark.createDataFrame([(a, b, r.randrange(1, 4)) for a, b in pairs], "u long, v long, weight long")
    got = {x.id: x.com for x in community.louvain(e, 4).collect()}
    assert got == {x.id: x.com for x in community._joined_louvain(e, 4, 700).collect()} and len(set(got.values())) < len(got) / 2
    plain = e.where("u < v").select("u", "v")
    near, want = ({x.id: x.centrality for x in f(plain, 7).collect()} for f in (community.eigenvector_centrality, community._joined_centrality))
    assert near.keys() == want.keys() and all(abs(near[k] - want[k]) < 1e-12 for k in near)
    assert community.louvain(plain.limit(0)).count() == community.eigenvector_centrality(plain.limit(0)).count() == 0
    monkeypatch.setattr(community, "_joined_louvain", lambda *a: pytest.fail("joins"))
    monkeypatch.setattr(community, "_joined_centrality", lambda *a: pytest.fail("joins"))
    assert community.louvain(e, 1).count() == community.eigenvector_centrality(e, 1).count() == len(got)
