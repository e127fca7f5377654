"""Utility evaluation over methods and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, structure, synthesizers


def utility_report(edges: DataFrame, methods: list[str], epsilons: list[float]) -> DataFrame:
    """method, epsilon, metric, original, synthetic, loss, fallback: scalar metrics and two distances of distributions."""
    real, n = synthesizers.compact(edges)
    parts = []
    for method in methods:
        for eps in epsilons:
            fake, failed = synthesizers.synthesize(real, n, eps, method)
            losses = compare.utility_losses(real, fake)
            ks = compare.ks(structure.degree_histogram(real), structure.degree_histogram(fake)).select(F.lit("degree_distribution").alias("metric"), F.lit(0.0).alias("original"), F.col("ks").alias("synthetic"), F.col("ks").alias("loss"))
            parts.append(losses.unionByName(ks).select(F.lit(method).alias("method"), F.lit(float(eps)).alias("epsilon"), "*", F.lit(failed).alias("fallback")))
    return reduce(DataFrame.unionByName, parts)


def summary(report: DataFrame) -> DataFrame:
    """Mean and deviation of the loss by method and budget; fallback rows are left out."""
    return report.where("NOT fallback").groupBy("method", "epsilon").agg(F.avg("loss").alias("overall_utility_loss_avg"), F.stddev_pop("loss").alias("overall_utility_loss_std"))
