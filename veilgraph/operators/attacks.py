"""Privacy attacks and their statistics.

A job is a row (target, epsilon, round, bit); worlds are sampled by draws, features are the engine's tables, models are
small forests, one group each. Statistics are plain two-level aggregates over result rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_correct, normalized_error
from . import structure


def mia_statistics(results: DataFrame) -> DataFrame:
    """results: target, epsilon, actual, prediction, success. One row an epsilon."""
    rate = lambda on, value: F.coalesce(F.avg(F.when(on, value)), F.lit(0.0))
    inside, pred = F.col("actual") == 1, F.col("prediction").cast("double")
    per = results.groupBy("epsilon", "target").agg(F.avg(F.col("success").cast("double")).alias("s")).groupBy("epsilon").agg(
        F.count("*").alias("unique_targets"), F.stddev_pop("s").alias("advantage_std"), (F.max("s") - F.min("s")).alias("advantage_range"))
    whole = results.groupBy("epsilon").agg(
        F.count("*").alias("total_attacks"), F.sum(inside.cast("long")).alias("in_member_attacks"), F.sum((~inside).cast("long")).alias("out_member_attacks"),
        rate(inside, pred).alias("tpr"), rate(~inside, pred).alias("fpr"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    return whole.join(per, "epsilon").withColumn("advantage", F.col("tpr") - F.col("fpr"))


def confidence_advantage(results: DataFrame) -> DataFrame:
    c = lambda k: F.coalesce(F.avg(F.when(F.col("actual") == k, F.col("confidence"))), F.lit(0.5))
    return results.groupBy("epsilon").agg(((c(1) + c(0)) / 2).alias("confidence_advantage"))


def aia_advantage(results: DataFrame, by: str = "attribute") -> DataFrame:
    """P(correct | st = 1) - P(correct | st = 0), 0 if a side is empty."""
    side = lambda k: F.avg(F.when(F.col("st") == k, F.col("correct").cast("double")))
    return results.groupBy(by).agg(F.count("*").alias("attacks"), F.coalesce(side(1) - side(0), F.lit(0.0)).alias("advantage"), F.avg("error").alias("mean_error"), F.expr("percentile(error, 0.5)").alias("median_error"), F.stddev_pop("error").alias("std_error"))


ATTRIBUTES = ("deg", "triangles", "neighbor_connection_ratio", "neighbor_avg_degree", "second_neighbor_count")


def attribute_ranges(features: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """attr, min, max, range (1 where there is none), mean, std, discrete (over 80 % integers)."""
    cells = features.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("x")) for a in attributes])).alias("c")).select("c.attr", "c.x")
    r = F.max("x") - F.min("x")
    whole = F.avg((F.abs(F.col("x") - F.rint("x")) < 1e-10).cast("double"))
    return cells.groupBy("attr").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.when(r < 1e-10, 1.0).otherwise(r).alias("range"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), (whole > 0.8).cast("int").alias("discrete"))


class Forest:
    """Bootstrap regression trees on few rows; their mean is a class's probability for 0/1 targets."""

    def __init__(self, trees: int = 50, depth: int = 10, least: int = 2, seed: int = 42):
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)

    def _grow(self, rows, depth):
        """rows: of those that were drawn, each once; self.drawn has how often."""
        w, y = self.drawn[rows].astype(float), self.y[rows]
        wy, total = w * y, int(w.sum())
        if depth == 0 or total < 2 * self.least or np.ptp(y) == 0:
            return float(wy.sum() / total)
        best, whole, wyy = None, wy.sum(), wy * y
        squares = wyy.sum()
        for f in self.rng.permutation(len(self.codes))[: max(1, int(np.sqrt(len(self.codes))) + 1)]:
            code, values = self.codes[f][rows], self.values[f]
            if len(values) <= 4 * len(rows):  # few values: no sorting
                n = np.bincount(code, w, len(values))
                at = np.flatnonzero(n)
                n, s, q = n[at], np.bincount(code, wy, len(values))[at], np.bincount(code, wyy, len(values))[at]
            else:
                order = np.argsort(code, kind="stable")
                own = code[order]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                at = own[first]
                n, s, q = (np.add.reduceat(t[order], first) for t in (w, wy, wyy))
            n, s, q = (np.cumsum(t)[:-1] for t in (n, s, q))
            if not len(n):
                continue
            cost = q - s * s / n + (squares - q) - (whole - s) ** 2 / (total - n)
            cost[(n < self.least) | (total - n < self.least)] = np.inf
            i = int(cost.argmin())
            if np.isfinite(cost[i]) and (best is None or cost[i] < best[0]):
                best = (cost[i], f, (values[at[i]] + values[at[i + 1]]) / 2, code <= at[i])
        if best is None:
            return float(whole / total)
        _, f, limit, left = best
        return f, limit, self._grow(rows[left], depth - 1), self._grow(rows[~left], depth - 1)

    def fit(self, x, y, row=None) -> Forest:
        """With row, the numbers of the rows of x and y that are meant, any of them any number of times."""
        self.grown, count = [], len(y) if row is None else len(row)
        self.y = np.asarray(y, float)
        self.values, self.codes = zip(*(np.unique(c, return_inverse=True) for c in np.asarray(x, float).T), strict=True)
        self.codes = [c.astype(np.int32) for c in self.codes]
        for _ in range(self.trees):
            i = self.rng.integers(0, count, count)
            self.drawn = np.bincount(i if row is None else row[i], minlength=len(y))
            self.grown.append(self._grow(np.flatnonzero(self.drawn), self.depth))
        del self.y, self.values, self.codes, self.drawn
        return self

    def predict(self, x) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.grown:
            for i, row in enumerate(x):
                node = tree
                while isinstance(node, tuple):
                    node = node[2] if row[node[0]] <= node[1] else node[3]
                out[i] += node
        return out / max(1, len(self.grown))


def infer_attribute(training: DataFrame, targets: DataFrame, attribute: str, ranges: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES, groups: int = 8) -> DataFrame:
    """Forests learned on a synthetic graph's features, in groups of nodes by hash, predict an attribute of the targets from
    the others. id, true_value, predicted_value, normalized_error, correct."""
    others = [a for a in attributes if a != attribute]
    stat = ranges.where(F.col("attr") == attribute).first()
    rows = training.select(*attributes, F.lit(None).cast("long").alias("id"), (F.abs(F.xxhash64(*attributes)) % groups).alias("g")).unionByName(
        targets.select(*attributes, "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asked = pdf[pdf.id.isna()], pdf[pdf.id.notna()]
        if len(known) < 5 or not len(asked):
            return pd.DataFrame({"id": [], "p": []})
        f = Forest(trees=max(1, 50 // groups), least=5).fit(known[others].to_numpy(float), known[attribute].to_numpy(float))
        return pd.DataFrame({"id": asked.id.astype("int64"), "p": f.predict(asked[others].to_numpy(float))})

    guess = rows.groupBy("g").applyInPandas(learn, "id long, p double").groupBy("id").agg(F.avg("p").alias("p"))
    discrete = bool(stat.discrete)
    p = F.greatest(F.rint("p"), F.lit(0.0)) if discrete else F.col("p")
    out = targets.join(guess, "id").select("id", F.col(attribute).cast("double").alias("true_value"), p.alias("predicted_value"))
    error = normalized_error(F.col("predicted_value"), F.col("true_value"), F.lit(float(stat["range"])))
    return out.withColumn("normalized_error", error).withColumn("correct", is_correct(F.col("predicted_value"), F.col("true_value"), F.lit(discrete), F.col("normalized_error")).cast("int"))


def membership_features(worlds: DataFrame) -> DataFrame:
    """worlds: (world, u, v). Ten features of each world's graph, all worlds at once: ids are world-tagged."""
    w = F.col("world") * 1_000_000_000
    e = worlds.select((w + F.least("u", "v")).alias("u"), (w + F.greatest("u", "v")).alias("v")).where("u <> v").distinct()
    base = structure.node_base(e).withColumn("world", F.floor(F.col("id") / 1_000_000_000))
    d = F.col("deg")
    return base.groupBy("world").agg(F.count("*").alias("n"), (F.sum(d) / 2).cast("long").alias("m"), F.avg(d).alias("mean_degree"), F.stddev_pop(d).alias("std_degree"), F.max(d).alias("max_degree"), F.min(d).alias("min_degree"),
                                     F.avg("clustering").alias("avg_clustering"), F.coalesce(F.try_divide(F.sum("triangles"), F.sum(d * (d - 1) / 2)), F.lit(0.0)).alias("transitivity"))


def membership_attack(edges: DataFrame, target: tuple[int, int], n: int, epsilon: float, method: str, shadows: int = 10, rounds: int = 4) -> DataFrame:
    """Shadow worlds with and without the target edge train a forest; it guesses the bit of further worlds."""
    from . import sampling, synthesizers

    u, v = target
    worlds, labels = None, []
    for k in range(2 * shadows + rounds):
        bit = k % 2 == 0
        own = sampling.training_edges(edges, u, v, bit, seed=1000 + k)
        own, failed = synthesizers.synthesize(own, n, epsilon, method)
        own = own.select(F.lit(k).cast("long").alias("world"), "u", "v")
        worlds = own if worlds is None else worlds.unionByName(own)
        labels.append((k, int(bit), k >= 2 * shadows, failed))
    spark = edges.sparkSession
    rows = membership_features(worlds).join(F.broadcast(spark.createDataFrame(labels, "world long, bit int, asked boolean, fallback boolean")), "world").withColumn("epsilon", F.lit(float(epsilon)))
    names = ["n", "m", "mean_degree", "std_degree", "max_degree", "min_degree", "avg_clustering", "transitivity"]

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asked = pdf[~pdf.asked], pdf[pdf.asked]
        p = Forest().fit(known[names].to_numpy(float), known.bit.to_numpy(float)).predict(asked[names].to_numpy(float))
        guess = (p > 0.5).astype("int32")
        return pd.DataFrame({"target": f"{u}-{v}", "epsilon": epsilon, "actual": asked.bit.to_numpy("int32"), "prediction": guess, "success": (guess == asked.bit.to_numpy()).astype("int32"), "confidence": np.where(asked.bit == 1, p, 1 - p), "fallback": asked.fallback.to_numpy()})

    return rows.groupBy("epsilon").applyInPandas(learn, "target string, epsilon double, actual int, prediction int, success int, confidence double, fallback boolean")


def group_sizes(rows: DataFrame, quasi: list[str]) -> DataFrame:
    """Linkage: each row with the size of its group of equal quasi-identifiers; 1 means it is linked."""
    return rows.join(rows.groupBy(*quasi).agg(F.count("*").alias("group_size")), quasi)
