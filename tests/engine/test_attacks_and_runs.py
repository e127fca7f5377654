import math
import random
import struct
from collections import Counter

import numpy as np
import pytest

from veilgraph.functions.noise import draw, drawn
from veilgraph.operators import attacks, community, compare, evaluation, influence, mechanisms, paths, structure, synthesizers, tabular, worlds
from veilgraph.plans import jobs
from veilgraph.session import cut_lineage
from veilgraph.sources import append_runs, followed, load_method, read_csr
from veilgraph import queries
from pyspark.sql import functions as F

from .test_structure import SMALL, graph, random_graph, steps


def two_cliques(k=6):
    return [(i + s, j + s) for s in (0, 10) for i in range(k) for j in range(i)] + [(0, 10)]


def test_betweenness_and_distances(spark):
    e = graph(spark, [(0, 1), (1, 2), (2, 3)])
    got = {(r.u, r.v): r.betweenness for r in paths.edge_betweenness(e).collect()}
    assert got == {(0, 1): pytest.approx(0.5), (1, 2): pytest.approx(4 / 6), (2, 3): pytest.approx(0.5)}
    square = {(r.u, r.v): r.betweenness for r in paths.edge_betweenness(graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3)])).collect()}
    assert list(square.values()) == pytest.approx([2 / 6] * 4)
    pairs = spark.createDataFrame([(0, 3), (3, 0), (1, 1), (0, 9), (0, 1)], "u long, v long")
    assert {(r.u, r.v): r.distance for r in paths.pair_distances(e, pairs).collect()} == {(0, 3): 3.0, (3, 0): 3.0, (1, 1): 0.0, (0, 9): 3.0, (0, 1): 1.0}


def test_betweenness_against_counting_paths(spark):
    pairs = random_graph(90, 110, 70)
    near = {x: [w for p in pairs if x in p for w in p if w != x] for x in {y for p in pairs for y in p}}
    far, want = steps(pairs), dict.fromkeys(pairs, 0.0)

    def count(s):
        """Shortest paths from s to each node."""
        out = {s: 1}
        for x in sorted(far[s], key=far[s].get):
            if x != s:
                out[x] = sum(out[w] for w in near[x] if far[s][w] == far[s][x] - 1)
        return out

    paths_from = {s: count(s) for s in near}
    for s in near:
        for t in far[s]:
            for u, v in pairs:
                for a, b in ((u, v), (v, u)):
                    if t != s and a in far[s] and far[s][a] + 1 + far[t][b] == far[s][t]:
                        want[u, v] += paths_from[s][a] * paths_from[t][b] / paths_from[s][t]
    n = len(near)
    rows = paths.edge_betweenness(graph(spark, pairs)).collect()
    assert len(rows) == len(pairs) and {(r.u, r.v): r.betweenness for r in rows} == pytest.approx({k: x / (n * (n - 1)) for k, x in want.items()})
    part = paths.edge_betweenness(graph(spark, pairs), spark.createDataFrame([(s,) for s in near], "id long")).collect()
    assert sum(r.betweenness for r in part) == pytest.approx(sum(r.betweenness for r in rows))


def test_betweenness_of_many_sources_in_one_pass(spark, monkeypatch):
    diamonds = [(3 * k + i, 3 * k + j) for k in range(110) for i, j in ((0, 1), (0, 2), (1, 3), (2, 3))]  # 2 ** 110 paths
    rows = paths.edge_betweenness(graph(spark, diamonds)).collect()
    n = 331

    def share(k):
        """Over an edge of diamond k: half of the pairs from side to side of it, or from its middle or the other middle."""
        left, right = 3 * k + 1, 3 * (109 - k) + 1
        return (left * right + 2 * left + 1) / (n * (n - 1)), (left * right + 2 * right + 1) / (n * (n - 1))

    for r in rows:
        k, first = r.u // 3, r.u % 3 == 0
        assert r.betweenness == pytest.approx(share(k)[0 if first else 1])
    held, passes = paths.held(graph(spark, diamonds)).value, []
    both, one = paths.Dependencies(paths.Adjacency(*held)), paths.Dependencies(paths.Adjacency(*held))
    add = paths.Dependencies._add
    monkeypatch.setattr(paths.Dependencies, "_add", lambda *x: passes.append(len(x[1])) or add(*x))
    monkeypatch.setattr(paths, "MOST_PATHS", 1e300)
    both.add(np.arange(10, 80))
    assert passes == [64, 6]
    monkeypatch.setattr(paths, "PIECE", 3)
    for s in range(10, 80):
        one.add(np.array([s]))
    assert both.edges()[2] == pytest.approx(one.edges()[2])


def test_measures_hold_a_graph_once(spark, monkeypatch):
    e, held, times = cut_lineage(graph(spark, random_graph(60, 150, 5))), paths.held, []
    monkeypatch.setattr(paths, "held", lambda *x: times.append(1) or held(*x))
    one = compare.measured(e)
    assert len(times) == 1
    empty = compare.measured(e.limit(0))
    assert {r.value for r in empty.scalars.collect()} == {0.0} and empty.communities.count() == empty.degrees.count() == 0
    regular = compare.measured(graph(spark, [(i, i + 1) for i in range(6)] + [(0, 6)]))
    assert {r.metric: r.value for r in regular.scalars.collect()}["assortativity"] == 0.0
    monkeypatch.setattr(community, "ROUNDS_EDGES", 0)
    many = compare.measured(e)
    value = lambda df: {r[0]: r[1] for r in df.collect()}
    for name in ("scalars", "degrees", "distances", "communities", "centrality"):
        assert value(getattr(one, name)) == pytest.approx(value(getattr(many, name)), abs=1e-9), name


def test_core_numbers_of_a_long_path(spark):
    e = graph(spark, [(i, i + 1) for i in range(30)] + [(0, 30)])
    assert {r.core for r in structure.core_numbers(e).collect()} == {2}
    assert {r.core for r in structure.core_numbers(graph(spark, [(i, i + 1) for i in range(30)])).collect()} == {1}


def test_communities(spark):
    e = graph(spark, two_cliques())
    labels = {r.id: r.com for r in community.best_partition(e).collect()}
    assert len({labels[i] for i in range(6)}) == 1 and len({labels[i] for i in range(10, 16)}) == 1 and labels[1] != labels[11]
    assert sorted(set(labels.values())) == list(range(len(set(labels.values()))))
    part = structure.vertices(e).selectExpr("id", "id div 10 AS com")
    assert community.weighted_modularity(e, part).first()[0] == pytest.approx(community.modularity(e, part).first()[0])


def test_followed_across_runs(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k, k * 7) for k in range(200)], "g string, k long, c long").repartition(7)
    got = sorted((r.c, r.next) for r in followed(rows, ["g"], "k", "c").collect())
    want = [(a * 7, b * 7) for g in (True, False) for own in [[k for k in range(200) if bool(k % 3) == g]] for a, b in zip(own, own[1:])]
    assert got == sorted(want)


def test_first_of_each_against_sorting(spark):
    rows = spark.createDataFrame([(w, i) for w in range(3) for i in range(500)], "world long, id long").withColumn("k", F.col("world") * 40 + 3)
    got = {(r.world, r.id) for r in worlds.first_of_each(rows, "world", draw(F.col("id") * 4099 + F.col("world"), 9), "id", "k").collect()}
    own = {}
    for r in rows.withColumn("d", draw(F.col("id") * 4099 + F.col("world"), 9)).collect():
        own.setdefault(r.world, []).append((r.d, r.id))
    assert got == {(w, i) for w, x in own.items() for _, i in sorted(x)[: w * 40 + 3]}


def test_perturbed_worlds_hold_what_is_kept_and_the_first_draws(spark, monkeypatch):
    """The kept edges are all in, and numbering draws in small steps changes nothing."""
    graphs = cut_lineage(graph(spark, random_graph(60, 150, 20)).withColumn("world", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).select("world", "u", "v"))
    eps = spark.createDataFrame([(0, 9.0), (1, 16.0)], "world long, epsilon double")
    want = None
    for size in (10_000, 7):
        monkeypatch.setattr(worlds, "DRAWS", size)
        fake, kept = ({tuple(r) for r in f(graphs, eps).collect()} for f in (worlds.perturbed, worlds.kept_edges))
        assert kept and kept < fake and (want is None or want == fake)
        want = fake
    rows = worlds._sizes(graphs, eps, 261).collect()
    assert {r.world: math.ceil(r.mt) for r in rows} == Counter(w for w, _, _ in want)


def test_membership_of_what_is_not_hidden(spark):
    """Without noise worth the name the attack mostly tells the edge's bit."""
    e = graph(spark, [(i, (i * 7 + 1) % 30) for i in range(30) if i != (i * 7 + 1) % 30] + [(i, i + 1) for i in range(29)]).distinct()
    out = evaluation.edge_membership(e, [2000.0], 2, 3, shadows=15)
    assert out.count() == 6 and out.agg(F.avg("success")).first()[0] > 0.75
    stats = attacks.mia_statistics(out).first()
    assert stats.total_attacks == 6 and stats.success_rate > 0.75 and stats.advantage > 0.5


def test_attribute_attack_runs_and_does_not_see_the_answer(spark):
    e = graph(spark, [(i, (i * 5 + 2) % 40) for i in range(40) if i != (i * 5 + 2) % 40] + [(i, (i + 1) % 40) for i in range(40)]).distinct()
    out = evaluation.node_attributes(e, [10.0], 2, 1)
    rows = out.collect()
    assert len(rows) == 4 and {r.st for r in rows} == {0, 1} and all(r.error >= 0 for r in rows)
    asked = evaluation.known_features(structure.node_features(e), spark.createDataFrame([(0, 1, 1, "deg"), (1, 2, 0, "triangles")], "world long, target long, st int, attribute string"), attacks.ATTRIBUTES).collect()
    assert all(r.attribute not in r.known and len(r.known) == 4 for r in asked)


def test_mechanisms(spark):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate([3, 1, 2, 5, 4, 4, 7, 0])], "i long, x double")
    fit = [r.fit for r in mechanisms.isotonic(rows, "i", "x").orderBy("i").collect()]
    assert fit == [2.0, 2.0, 2.0] + [4.0] * 5 or fit == pytest.approx([2, 2, 2, 4, 4, 4, 4, 4])
    low = spark.createDataFrame([(x,) for x in (-(10**12), 5, 9, 100)], "x long")
    got = mechanisms.norm_sub(low).first()
    assert got["shift"] == 100 and mechanisms.norm_sub(spark.createDataFrame([(3,), (1,)], "x long")).first()["shift"] == 0
    assert mechanisms.norm_sub(low.limit(0)).count() == 0
    for degrees, ok in (([3, 3, 3, 3], 1), ([3, 1, 1], 0), ([4, 4, 4, 1, 1], 0), ([2, 2, 1, 1], 1), ([1], 0)):
        h = spark.createDataFrame([(d,) for d in degrees], "deg long").groupBy("deg").count().withColumnRenamed("count", "cnt")
        assert mechanisms.graphical(h).first()[0] == ok, degrees


def test_synthesizers_spend_their_budget(spark):
    e = graph(spark, [(i, (i * i + 3) % 60) for i in range(60) if i != (i * i + 3) % 60] + [(i, (i + 1) % 60) for i in range(60)]).distinct()
    real, n = synthesizers.compact(e)
    m = real.count()
    for name in ("hrg", "privgraph", "skg", "privdpr"):
        made = {eps: sorted(map(tuple, synthesizers.synthesize(real, n, eps, name)[0].collect())) for eps in (0.5, 20.0)}
        assert made[0.5] != made[20.0], name
        assert abs(len(made[20.0]) - m) <= 0.35 * m, (name, len(made[20.0]), m)
    degrees = spark.createDataFrame([(0, 5), (1, 1), (2, 1)], "id long, deg long")
    made = spark.createDataFrame(synthesizers.havel_hakimi([(0, 5), (1, 1), (2, 1)]), "u long, v long")
    assert synthesizers.shortfall(degrees, made).first().missing == 3


def test_influence(spark):
    star = graph(spark, [(0, i) for i in range(1, 8)] + [(10, 11), (11, 12)])
    assert [r.id for r in influence.seeds(star, 2).orderBy("rank").collect()] == [0, 11]
    sure = influence.spread(star.withColumn("weight", F.lit(1)), spark.createDataFrame([(0,)], "id long"), 3, 1.0).first()
    assert sure.spread == 8 and sure.least == sure.most == 8
    walks = influence.random_walks(star, 2, 5)
    assert walks.groupBy("walk").count().where("count <> 5").isEmpty()
    rows = spark.createDataFrame([(1, 5.0, 0), (1, 1.0, 1), (2, 3.0, 2)], "k long, p double, seq long")
    assert [(r.k, r.p) for r in influence.merge_queues(rows, "k", "p").orderBy("rank").collect()] == [(1, 1.0), (2, 3.0)]


def test_cascades_of_searches_and_of_joins_agree(spark):
    e = graph(spark, random_graph(80, 120, 40)).withColumn("weight", F.col("u") % 3 + 1)
    start = spark.createDataFrame([(0,), (7,), (7,), (5000,)], "id long")
    got, want = (sorted(map(tuple, f(e, start, 12, 0.2).select("run", "id").collect())) for f in (influence.cascades, influence._joined_cascades))
    assert got == want and len(got) > 3 * 12
    keys = [0, 5, 2**40 + 3, 2**60]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", draw(F.col("k"), 401)).collect()
    assert [int(x) for x in drawn(np.array([r[0] for r in rows]), 401)] == [r[1] for r in rows]


def test_nearest_against_sorting(spark):
    """Ties in distance go by label, also where a value has many copies or two values are as far."""
    r = random.Random(6)
    rows = [(i, r.choice([1.0, 2.0, 3.0, 4.5, 7.0]), float(r.randrange(3)), i % 4) for i in range(300)] + [(900, 40.0, 1.0, 2), (901, None, 1.0, 0)]
    asked = [(i, x, 1.0) for i, x in enumerate([0.0, 1.5, 2.0, 2.5, 39.0, 100.0, 20.0])]
    data, targets = spark.createDataFrame(rows, "k long, x double, z double, y long"), spark.createDataFrame(asked, "k long, x double, z double")
    for numbers, place in ((["x"], (1,)), (["x", "z"], (1, 2))):
        for parts in (1, 6):
            got = {x.k: x.guess for x in tabular.nearest(data.repartition(parts), targets, numbers, "y", "k").collect()}
            for t in asked:
                near = sorted((sum((w[c] - t[c]) ** 2 for c in place), w[3]) for w in rows if w[1] is not None)[:5]
                assert got[t[0]] == pytest.approx(sum(y for _, y in near) / 5), (numbers, t)
    few = tabular.nearest(data.where("k < 3"), targets, ["x"], "y", "k").collect()
    assert {x.guess for x in few} == {1.0} and "CartesianProduct" not in (plan := tabular.nearest(data, targets, ["x"], "y", "k")._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_tabular(spark):
    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, "ab"[i % 2] if i % 3 else None, float(2 * (i % 7) + 1)) for i in range(200)], "k long, x double, c string, y double")
    full = tabular.imputed(rows, ["x"], ["c"])
    assert full.where("x IS NULL OR c IS NULL").isEmpty() and full.count() == 200
    meta = tabular.Metadata.of(full, ["x"], ["c"], 3)
    assert {r.x for r in tabular.binned(full, meta).select("x").distinct().collect()} == {0, 1, 2} and {r.c for r in tabular.coded(full, meta).select("c").distinct().collect()} == {0, 1}
    line = tabular.LinearReconstruction(["x"], "y").train(rows)
    assert list(line.coefficients) == pytest.approx([1.0, 2.0]) and line.sigma == pytest.approx(0, abs=1e-4)
    for name in tabular.CLASSIFIERS:
        data = full.withColumn("label", (F.col("x") > 3).cast("int"))
        out = tabular.MembershipClassifier(["x"], ["c"], classifier=name).train(data).attack(data)
        assert out.where("guess = label").count() >= 190, name
    linked = tabular.MembershipClassifier(["x"], ["c"], ["k"], "LogisticRegression").train(full.withColumn("label", (F.col("x") > 3).cast("int"))).attack(full)
    assert linked.where("linked AND guess = 1 AND confidence = 1").count() == 200
    read = tabular.ForestReconstruction(["x"], [], "c", ["k"]).train(full).attack(full)
    assert read.where("guess = c").count() == 200
    data = tabular.shadow_data(full, "k", full.limit(3), 2, 50)
    assert {(r.shadow, r.label): r["count"] for r in data.groupBy("shadow", "label").count().collect()} == {(s, b): 50 for s in (0, 1) for b in (0, 1)}


def test_losses_of_a_graph_against_itself(spark):
    e = graph(spark, two_cliques())
    m = compare.measured(e)
    rows = {r.metric: r.loss for r in compare.all_losses(m, m).collect()}
    assert set(rows) == set(compare.TASKS) and all(v == pytest.approx(0, abs=1e-9) for v in rows.values())
    own = jobs.standalone_losses(m, m, 12).first().asDict()
    assert list(own) == list(jobs.STANDALONE) and own["CD_NMI"] == pytest.approx(1) and all(v == pytest.approx(0, abs=1e-9) for k, v in own.items() if k != "CD_NMI")


def test_a_step_of_a_search_leaves_out_what_adds_nothing(monkeypatch):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(1500)} | {(i, 400) for i in range(0, 400, 3)} | {(i, i + 1) for i in range(401, 440)}
    key = np.array(sorted(x for a, b in pairs for x in (a << 32 | b, b << 32 | a)))
    ids = np.arange(441)
    own = paths.Adjacency(ids, np.searchsorted(key, np.arange(442) << 32), (key & 0xFFFFFFFF).astype(np.int32), {})
    sources, found = np.arange(300, 441), []
    monkeypatch.setattr(paths, "STEP_BYTES", 1 << 11)
    for sparse, soon in ((0, 9), (9, 9), (0, 0), (0.35, 0.2)):  # all neighbours, those of the front alone, nodes left early
        monkeypatch.setattr(paths, "SPARSE", sparse)
        monkeypatch.setattr(paths, "SOON", soon)
        search, rows = paths.Search(own), []
        for front in search.levels(sources):
            assert search.count == np.bitwise_count(front).sum()
            rows.append(front.copy())
        found.append(rows)
    far = steps(sorted(pairs))
    for rows in found:
        assert len(rows) == 1 + max(max(far[s].values()) for s in sources.tolist())
        for d, front in enumerate(rows):
            assert all((int(front[search.rank[v], k // 64]) >> k % 64 & 1) == (far[s].get(v) == d) for k, s in enumerate(sources.tolist()) for v in range(441))


def test_moves_in_pieces(monkeypatch):
    pairs = random_graph(90, 110, 70)
    key = np.array(sorted({x for a, b in pairs for x in (a << 32 | b, b << 32 | a)}))
    ids, ends = np.unique(key >> 32, return_inverse=True)
    own = paths.Adjacency(ids, np.searchsorted(ends, np.arange(len(ids) + 1)), np.searchsorted(ids, key & 0xFFFFFFFF).astype(np.int32), {})
    whole = community._moves(own)[1].tolist()
    monkeypatch.setattr(community, "MOVED_ARCS", 16)
    assert community._moves(own)[1].tolist() == whole
    own.more["weight"] = np.ones(len(key), np.int64)
    assert community._moves(own)[1].tolist() == whole
    assert community.ROUNDS_EDGES == paths.BROADCAST_EDGES  # what is held for distances is held for all measures


def test_a_method_that_fails_is_no_result(spark, monkeypatch):
    def fails(edges, n, epsilon):
        raise ValueError("can't fit")

    e = graph(spark, two_cliques())
    monkeypatch.setitem(synthesizers.REGISTRY, "fails", fails)
    with pytest.raises(ValueError, match="can't fit"):
        jobs.standalone(e, ["fails"], [10.0], 1)
    assert synthesizers.synthesize(e, 16, 10.0, "fails")[1]  # for those that mark it
    monkeypatch.setitem(synthesizers.REGISTRY, "tmf", fails)
    for f in (queries.utility_full, queries.utility_loss_scalar):
        with pytest.raises(ValueError, match="can't fit"):
            f(e)


def test_runs(spark, tmp_path):
    e = graph(spark, two_cliques())
    configs = [jobs.resolved("utility", methods=("tmf", "unknown"), epsilons=(5.0,), rounds=1, out=str(tmp_path / "out"))]
    assert len(jobs.matrix(configs)) == 2 and jobs.resolved("aia").rounds == 20 and jobs.resolved("mia", rounds=None).rounds == 10
    runs = jobs.run_all(spark, e, [jobs.resolved("utility", methods=("tmf",), epsilons=(5.0,), rounds=2, out=str(tmp_path / "out"))])
    assert {r.status: r.runs for r in jobs.tally(runs).collect()} == {"ok": 1}
    table = spark.read.option("header", True).csv(str(tmp_path / "out/utility-tmf_statistics"))
    assert table.count() == 1 and "diameter_loss_avg" in table.columns
    append_runs(runs, str(tmp_path / "runs"))
    append_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    with pytest.raises(KeyError):
        jobs.run_all(spark, e, configs)
    with pytest.raises(SystemExit) as stop:
        jobs.main(spark, e, [jobs.resolved("utility", methods=("tmf",), epsilons=(5.0,), rounds=1)])
    assert stop.value.code == 0


def test_sources(spark, tmp_path):
    # three nodes, links 0-1, 0-2 from both sides
    (tmp_path / "g.bin").write_bytes(struct.pack("<i3q4i", 3, 2, 3, 4, 1, 2, 0, 0))
    assert sorted(map(tuple, read_csr(spark, str(tmp_path / "g.bin")).collect())) == [(0, 1), (0, 2)]
    (tmp_path / "m.py").write_text("def keep(edges, n, epsilon):\n    return edges\n")
    assert load_method(str(tmp_path / "m.py"), "keep")(1, 2, 3) == 1
    with pytest.raises(AttributeError):
        load_method(str(tmp_path / "m.py"), "none")


def test_every_query_with_sql_has_a_name_of_its_own():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and math.isclose(len(queries.QUERIES), len(set(queries.QUERIES)))


def test_edge_worlds_in_a_task_are_those_of_tables(spark, monkeypatch):
    """Features of the perturbed worlds of edge targets: drawn in a task that holds the graph, and by joins."""
    import random

    from veilgraph.operators import paths

    r = random.Random(8)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(70), r.randrange(70)) for _ in range(500)) if a != b} | {(900, 901)})
    e = spark.createDataFrame(pairs, "u long, v long")
    jobs = [(i, *(pairs[i * 7 % len(pairs)] if i else pairs[-1]), i % 2, [0.5, 2.0, 10.0, 40.0][i % 4]) for i in range(24)]
    w = spark.createDataFrame(jobs, "world long, u long, v long, bit int, epsilon double")
    fake = worlds.perturbed(worlds.edge_worlds(e, w.select("world", "u", "v", "bit")), w.select("world", "epsilon"))
    want = {x.world: x.features for x in worlds.edge_target_features(fake, w.select("world", "u", "v")).collect()}
    with monkeypatch.context() as m:
        for name in ("induced", "perturbed"):
            m.setattr(worlds, name, lambda *a: pytest.fail("worlds are written"))
        got = {x.world: x.features for x in worlds.edge_membership_features(e, w).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    assert sum(any(x) for x in got.values()) > 12
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 10)
    some = w.where("world < 4")
    assert {x.world: x.features for x in worlds.edge_membership_features(e, some).collect()} == {k: want[k] for k in range(4)}


def test_node_worlds_in_a_task_are_those_of_tables(spark, monkeypatch):
    """Features of the perturbed worlds of node targets: drawn in a task that holds the graph, and by joins."""
    r = random.Random(9)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(420)) if a != b} | {(900, 901)})
    e = spark.createDataFrame(pairs, "u long, v long")
    w = spark.createDataFrame([(i, i * 5 % 60 if i else 900, i % 2, [0.5, 2.0, 10.0, 40.0][i // 2 % 4]) for i in range(24)], "world long, target long, bit int, epsilon double")
    fake = worlds.perturbed(cut_lineage(worlds.shadow_worlds(e, w)), w.select("world", "epsilon"))
    want = {x.world: x.features for x in worlds.node_target_features(fake, w.select("world", "target")).collect()}
    with monkeypatch.context() as m:
        for name in ("induced", "perturbed", "shadow_worlds"):
            m.setattr(worlds, name, lambda *a: pytest.fail("worlds are written"))
        m.setattr(worlds, "PATHS", 50)
        got = {x.world: x.features for x in worlds.node_membership_features(e, w).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert sum(all(x) for x in got.values()) > 6


def test_forest_of_repeated_rows_is_that_of_all_rows():
    r = np.random.default_rng(4)
    x, y, row = r.integers(0, 9, (40, 3)) / 4, r.integers(0, 5, 40).astype(float), r.integers(0, 40, 700)
    asked = r.random((20, 3)) * 2
    want = attacks.Forest(trees=8, least=5).fit(x[row], y[row]).predict(asked)
    assert len(set(want)) > 5 and attacks.Forest(trees=8, least=5).fit(x, y, row).predict(asked) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("of_edges", [False, True])
def test_attribute_worlds_in_a_task_are_those_of_tables(spark, monkeypatch, of_edges):
    """Jobs, true values and sizes; a forest's guess hangs on the order of the rows, which tables don't have."""
    e = cut_lineage(graph(spark, random_graph(60, 240, 21)))
    attack = evaluation.edge_attributes if of_edges else evaluation.node_attributes
    own = lambda: {(x.epsilon, x.target, x.st): (x.attribute, x.true_value, x.training_samples) for x in attack(e, [8.0, 20.0], 3, 1).collect()}
    with monkeypatch.context() as m:
        m.setattr(worlds, "perturbed", lambda *a: pytest.fail("worlds are written"))
        got = own()
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 10)
    assert got == own() and len(got) == 12


def test_attribute_tables_against_counting(monkeypatch):
    monkeypatch.setattr(worlds, "PATHS", 50)
    r = random.Random(3)
    for n, m in ((40, 260), (40, 60), (9, 40), (200, 300)):
        e = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})
        u, v = (np.array(x, np.int32) for x in zip(*e, strict=True))
        near = [set() for _ in range(n)]
        for a, b in e:
            near[a].add(b)
            near[b].add(a)
        deg = [len(x) for x in near]
        t = [sum(y in near[x] for x in near[i] for y in near[i]) // 2 for i in range(n)]
        ratio = [2 * t[i] / (deg[i] * (deg[i] - 1)) if deg[i] > 1 else 0 for i in range(n)]
        row, table = worlds.edge_table(n, u, v)
        for k, (a, b) in enumerate(e):
            c = len(near[a] & near[b])
            assert [table[x][row[k]] for x in evaluation.EDGE_ATTRIBUTES] == pytest.approx([c, c / len(near[a] | near[b]), deg[a] * deg[b], abs(deg[a] - deg[b]), (ratio[a] + ratio[b]) / 2])
        here, table = worlds.node_table(n, u, v)
        assert here.tolist() == [i for i in range(n) if deg[i]]
        for k, i in enumerate(here.tolist()):
            two = {y for x in near[i] for y in near[x]} - {i}
            assert [table[x][k] for x in attacks.ATTRIBUTES] == pytest.approx([deg[i], t[i], ratio[i], np.mean([deg[x] for x in near[i]]), len(two)])
