"""Privacy evaluation as tables: jobs are rows, worlds of all jobs are drawn and measured at once, one model a job.

Membership: of each job (epsilon, target, round) shadow worlds with and without the target teach a forest, which guesses
the bit of a further world. Attributes: of each job (epsilon, target, st, round) a model learned on the nodes of a
perturbed training graph predicts a hidden attribute of the target, which the attacker knows otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_correct, normalized_error
from ..functions.noise import draw, drawn
from ..session import cut_lineage
from . import attacks, paths, structure, worlds

#: Worlds of a job: shadow pairs take the even and odd numbers, the asked world is the last.
SHADOWS = 10


def job_table(spark: SparkSession, epsilons: list[float], targets: DataFrame, rounds: int) -> DataFrame:
    """targets: (target_no, ...). (job, epsilon, round, target_no, ...): each epsilon with each target and round, numbered."""
    eps = spark.createDataFrame([(i, float(x)) for i, x in enumerate(epsilons)], "epsilon_no long, epsilon double")
    count = targets.count()
    rows = targets.crossJoin(F.broadcast(eps)).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    return rows.withColumn("job", (F.col("epsilon_no") * count + F.col("target_no")) * rounds + F.col("round")).drop("epsilon_no")


def membership_worlds(jobs: DataFrame, shadows: int = SHADOWS) -> DataFrame:
    """(world, job, bit, asked, ...): 2 * shadows worlds with bits 1, 0, 1, 0, ... and one asked world whose bit is drawn."""
    each = 2 * shadows + 1
    rows = jobs.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))))
    asked = F.col("nth") == each - 1
    return rows.withColumn("world", F.col("job") * each + F.col("nth")).withColumn("asked", asked).withColumn("bit", F.when(asked, draw(F.col("job"), 301) % 2).otherwise((F.col("nth") + 1) % 2).cast("int"))


def membership_results(rows: DataFrame) -> DataFrame:
    """rows: (job, epsilon, target, bit, asked, features). One row a job: the forest's guess of the asked world's bit. It
    learns from the first 80 % of the shadow worlds, scaled by their mean and deviation."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("world")
        known, one = pdf[~pdf.asked], pdf[pdf.asked].iloc[0]
        known = known.iloc[: max(1, int(0.8 * len(known)))]
        x, y = pd.DataFrame(known.features.tolist()).to_numpy(float), known.bit.to_numpy(float)
        mean, deviation = x.mean(0), x.std(0)
        scaled = lambda v: (v - mean) / (deviation + (deviation == 0))
        p = float(attacks.Forest(least=2).fit(scaled(x), y).predict(scaled(pd.DataFrame([one.features]).to_numpy(float)))[0]) if len(set(y)) > 1 else 0.5
        guess = int(p > 0.5)
        return pd.DataFrame([{"job": one.job, "epsilon": one.epsilon, "target": one.target, "actual": int(one.bit), "prediction": guess, "success": int(guess == one.bit), "confidence": p if one.bit else 1 - p}])

    return rows.select("job", "world", "epsilon", "target", "bit", "asked", "features").groupBy("job").applyInPandas(learn, "job long, epsilon double, target string, actual int, prediction int, success int, confidence double")


def node_membership(edges: DataFrame, epsilons: list[float], k: int, rounds: int, shadows: int = SHADOWS) -> DataFrame:
    """Results of the attack on k node targets."""
    edges = cut_lineage(edges.select("u", "v"))
    chosen = worlds.targets(structure.vertices(edges), F.col("id"), k).withColumnRenamed("id", "node")
    w = cut_lineage(membership_worlds(job_table(edges.sparkSession, epsilons, chosen, rounds), shadows))
    features = worlds.node_membership_features(edges, w.withColumnRenamed("node", "target"))
    return membership_results(w.withColumn("target", F.col("node").cast("string")).join(features, "world"))


def edge_membership(edges: DataFrame, epsilons: list[float], k: int, rounds: int, shadows: int = SHADOWS) -> DataFrame:
    """Results of the attack on k edge targets."""
    edges = cut_lineage(edges.select("u", "v"))
    chosen = worlds.targets(edges.select("u", "v"), F.col("u") * 2000003 + F.col("v"), k, 202)
    w = cut_lineage(membership_worlds(job_table(edges.sparkSession, epsilons, chosen, rounds), shadows))
    features = worlds.edge_membership_features(edges, w)
    return membership_results(w.withColumn("target", F.concat_ws("-", "u", "v")).join(features, "world"))


def sensitive_attribute(job: Column, attributes: tuple[str, ...], stream: int = 311) -> Column:
    """One of the attributes, by draw."""
    return F.element_at(F.array(*map(F.lit, attributes)), (draw(job, stream) % len(attributes) + 1).cast("int"))


def attribute_jobs(jobs: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """(world, st, attribute, ...): each job with the target in the training graph and without it, and the attribute to guess."""
    rows = jobs.withColumn("st", F.explode(F.array(F.lit(1), F.lit(0))))
    return rows.withColumn("world", F.col("job") * 2 + F.col("st")).withColumn("attribute", sensitive_attribute(F.col("job"), attributes))


def known_features(features: DataFrame, w: DataFrame, attributes: tuple[str, ...], stream: int = 321) -> DataFrame:
    """(world, known, true_value): what the attacker knows of the target, all attributes but the hidden one. Without the
    target in the training graph he has the features of another node, drawn, but is judged by the target's value."""
    own = F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(a).cast("double"))])
    table = cut_lineage(features.select("id", own.alias("f")))
    order = cut_lineage(structure.ranked(table, "id"))
    n = order.count()
    other = w.withColumn("idx", draw(F.col("world"), stream) % n)
    other = other.join(order.select("idx", F.col("id").alias("other"), F.col("f").alias("fake")), "idx")
    rows = other.join(table.select(F.col("id").alias("target"), F.col("f").alias("real")), "target")
    shown = F.when(F.col("st") == 1, F.col("real")).otherwise(F.col("fake"))
    return rows.select("world", "attribute", F.map_filter(shown, lambda k, v: k != F.col("attribute")).alias("known"), F.element_at("real", F.col("attribute")).alias("true_value"))


def node_attributes(edges: DataFrame, epsilons: list[float], k: int, rounds: int, attributes: tuple[str, ...] = attacks.ATTRIBUTES) -> DataFrame:
    """Results of the attack on attributes of k node targets: epsilon, target, st, attribute, true and predicted value,
    errors, correct, training_samples; jobs whose graph has too few nodes are left out."""
    spark, edges = edges.sparkSession, cut_lineage(edges.select("u", "v"))
    chosen = worlds.targets(structure.vertices(edges), F.col("id"), k, 203).withColumnRenamed("id", "target")
    w = cut_lineage(attribute_jobs(job_table(spark, epsilons, chosen, rounds), attributes))
    if edges.count() <= paths.BROADCAST_EDGES:
        return _guessed_in_tasks(edges, w, attributes, 10, False)
    real = cut_lineage(structure.node_features(edges))
    nodes = worlds.training_nodes(structure.vertices(edges), w.select("world", "target", "st"))
    fake = cut_lineage(worlds.perturbed(worlds.induced(edges, nodes), w.select("world", "epsilon")))
    rows = worlds.of_world(structure.node_features(cut_lineage(worlds.tagged(fake)))).select("world", *[F.col(a).cast("double").alias(a) for a in attributes])
    asked = known_features(real, w.select("world", "target", "st", "attribute"), attributes)
    return _guessed(w, rows, asked, real, attributes, 10)


def _guessed(w: DataFrame, rows: DataFrame, asked: DataFrame, real: DataFrame, attributes: tuple[str, ...], least: int) -> DataFrame:
    """A forest a world learns on its rows and predicts what is asked."""
    rows = rows.select("world", *attributes, F.lit(False).alias("asked"), F.lit(None).cast("string").alias("attribute")).unionByName(
        asked.select("world", *[F.coalesce(F.element_at("known", F.lit(a)), F.lit(0.0)).alias(a) for a in attributes], F.lit(True).alias("asked"), "attribute"))
    names = list(attributes)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        known, one = pdf[~pdf.asked], pdf[pdf.asked]
        if len(known) < least or one.empty:
            return pd.DataFrame({"world": [], "predicted": [], "training_samples": []})
        hidden = one.attribute.iloc[0]
        use = [a for a in names if a != hidden]
        p = attacks.Forest(least=5).fit(known[use].to_numpy(float), known[hidden].to_numpy(float)).predict(one[use].to_numpy(float))[0]
        return pd.DataFrame([{"world": one.world.iloc[0], "predicted": p, "training_samples": len(known)}])

    guess = rows.groupBy("world").applyInPandas(learn, "world long, predicted double, training_samples long")
    ranges = attacks.attribute_ranges(real, attributes).select(F.col("attr").alias("attribute"), "range", "discrete")
    return _judged(w.join(guess, "world").join(asked.select("world", "true_value"), "world").join(F.broadcast(ranges), "attribute"))


def _judged(out: DataFrame) -> DataFrame:
    """out: jobs with predicted, true_value, range and discrete."""
    p = F.when(F.col("discrete") == 1, F.greatest(F.rint("predicted"), F.lit(0.0))).otherwise(F.col("predicted"))
    out = out.withColumn("predicted_value", p).withColumn("absolute_error", F.abs(p - F.col("true_value")))
    out = out.withColumn("error", normalized_error(F.col("predicted_value"), F.col("true_value"), F.col("range")))
    out = out.withColumn("correct", is_correct(F.col("predicted_value"), F.col("true_value"), F.col("discrete") == 1, F.col("error")).cast("int"))
    return out.select("epsilon", "target", "st", "round", "attribute", "true_value", "predicted_value", "absolute_error", "error", "correct", "training_samples")


def _guessed_in_tasks(edges: DataFrame, w: DataFrame, attributes: tuple[str, ...], least: int, of_edges: bool) -> DataFrame:
    """The same over a held graph: a world is drawn, measured and learned from in one task and never written; one task before
    them measures the graph itself."""
    ends, names = worlds.held_ends(edges), list(attributes)
    plan = w.select("world", "st", "attribute", *("u", "v") if of_edges else ("target", F.lit(None).cast("long").alias("v")), F.col("epsilon").cast("double").alias("epsilon"))

    def place(own: worlds.Worlds, u, v) -> list[int]:
        return np.searchsorted(own.ids, sorted((u, v)) if of_edges else [u]).tolist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not jobs:
            return
        own = worlds.Worlds(*ends.value)
        if of_edges:
            key = own.ids[own.u] * 2000003 + own.ids[own.v]
            row, table = worlds.edge_table(own.n, own.u, own.v)
        else:
            here, table = worlds.node_table(own.n, own.u, own.v)
            key, row = own.ids[here], np.arange(len(here), dtype=np.int32)
        order = np.argsort(key)
        key, row = key[order], row[order]
        times, out = np.bincount(row), []
        for world, st, hidden, u, v, _ in jobs:
            real = row[np.searchsorted(key, min(u, v) * 2000003 + max(u, v) if of_edges else u)]
            shown = real if st == 1 else row[int(drawn(np.array([world], np.int64), 321)[0]) % len(row)]
            x = table[hidden]
            span, whole = float(x.max() - x.min()), float(times[np.abs(x - np.rint(x)) < 1e-10].sum() / len(row))
            out.append((world, [0.0 if a == hidden else float(table[a][shown]) for a in names], float(x[real]), span if span >= 1e-10 else 1.0, int(whole > 0.8)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32()), strict=True)], ["world", "known", "true_value", "range", "discrete"])

    def learn(own: worlds.Worlds, world, st, hidden, u, v, epsilon, known):
        x = place(own, u, v)
        graph = own.perturbed(world, *(own.edge_world(world, *x, st) if of_edges else own.training_world(world, *x, st)), epsilon)
        if not len(graph[0]):
            return None
        row, table = (worlds.edge_table if of_edges else worlds.node_table)(own.n, *graph)
        if len(row) < least:
            return None
        if not of_edges:  # nodes that are alike are one row, as edges are
            alike = worlds.combined([np.unique(x, return_inverse=True)[1] for x in table.values()])
            _, first, row = np.unique(alike, return_index=True, return_inverse=True)
            table = {a: x[first] for a, x in table.items()}
        use = [a for a in names if a != hidden]
        forest = attacks.Forest(least=5).fit(np.stack([table[a] for a in use], 1), table[hidden], row)
        return world, float(forest.predict(np.array([[known[names.index(a)] for a in use]]))[0]), len(row)

    asked = cut_lineage(plan.coalesce(1).mapInArrow(measure, "world long, known array<double>, true_value double, range double, discrete int"))
    guess = worlds.in_tasks(ends, plan.join(asked.select("world", "known"), "world"), learn, "world long, predicted double, training_samples long")
    return _judged(w.join(cut_lineage(guess), "world").join(asked.drop("known"), "world"))


EDGE_ATTRIBUTES = ("common_neighbors", "jaccard", "preferential_attachment", "degree_difference", "mean_clustering")


def edge_attributes(edges: DataFrame, epsilons: list[float], k: int, rounds: int, attributes: tuple[str, ...] = EDGE_ATTRIBUTES) -> DataFrame:
    """As node_attributes, of k edge targets: training graphs hold both ends, and the edge itself if st is 1."""
    key, edges = F.col("u") * 2000003 + F.col("v"), cut_lineage(edges.select("u", "v"))
    chosen = worlds.targets(edges, key, k, 204)
    w = cut_lineage(attribute_jobs(job_table(edges.sparkSession, epsilons, chosen, rounds), attributes))
    if edges.count() <= paths.BROADCAST_EDGES:
        return _guessed_in_tasks(edges, w.withColumn("target", key), attributes, 5, True)
    graphs = cut_lineage(worlds.edge_worlds(edges, w.select("world", "u", "v", F.col("st").alias("bit"))))
    fake = cut_lineage(worlds.perturbed(graphs, w.select("world", "epsilon")))
    real = cut_lineage(structure.edge_features(edges).withColumn("id", key))
    rows = worlds.of_world(structure.edge_features(cut_lineage(worlds.tagged(fake))), "u").select("world", *[F.col(a).cast("double").alias(a) for a in attributes])
    plan = w.withColumn("target", key)
    return _guessed(plan, rows, known_features(real, plan.select("world", "target", "st", "attribute"), attributes), real, attributes, 5)


def attribute_table(results: DataFrame) -> DataFrame:
    """One row an epsilon: the share of right guesses with and without the target, their difference, and its spread."""
    side = lambda k: F.coalesce(F.avg(F.when(F.col("st") == k, F.col("correct").cast("double"))), F.lit(0.0))
    per = results.groupBy("epsilon", "target").agg(F.avg(F.col("correct").cast("double")).alias("s")).groupBy("epsilon").agg(
        F.count("*").alias("unique_targets"), F.when(F.count("*") > 1, F.stddev_pop("s")).otherwise(0.0).alias("advantage_std"), (F.max("s") - F.min("s")).alias("advantage_range"))
    whole = results.groupBy("epsilon").agg(F.count("*").alias("total_attacks"), F.count_if(F.col("st") == 1).alias("in_member_attacks"), F.count_if(F.col("st") == 0).alias("out_member_attacks"), side(1).alias("tpr"), side(0).alias("fpr"), F.avg(F.col("correct").cast("double")).alias("success_rate"))
    return whole.withColumn("advantage", F.col("tpr") - F.col("fpr")).join(per, "epsilon")


def best_and_worst(results: DataFrame, success: str = "success") -> DataFrame:
    """One row an epsilon: mean, highest and lowest share of successes of a target, and those targets (the least name on ties)."""
    per = results.groupBy("epsilon", F.col("target").cast("string").alias("target")).agg(F.avg(F.col(success).cast("double")).alias("s"))
    return per.groupBy("epsilon").agg(F.avg("s").alias("mean_success"), F.max("s").alias("best_success"), F.min("s").alias("worst_success"), F.min_by("target", F.struct(-F.col("s"), "target")).alias("best_target"), F.min_by("target", F.struct("s", "target")).alias("worst_target"))


def attack_summary(results: DataFrame) -> DataFrame:
    """By attribute and side: attacks, share right, mean error."""
    return results.groupBy("attribute", "st").agg(F.count("*").alias("attacks"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("error").alias("mean_error"))
