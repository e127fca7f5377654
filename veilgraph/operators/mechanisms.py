"""Differential-privacy mechanisms as expressions and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import laplace, laplace_clamped, uniform
from . import structure


def budget_shares(epsilon: float, parts: int) -> list[float]:
    return [epsilon / parts] * parts


def gaussian_sigma(epsilon: float, delta: float, steps: int, clip: float = 1.0) -> float:
    return math.sqrt(2 * math.log(1.25 * steps / delta)) / epsilon * clip


def noisy_degrees(edges: DataFrame, epsilon: float, seed: int = 21) -> DataFrame:
    """(id, deg, noisy): max(0, half-even round of deg + Laplace(1 / epsilon))."""
    d = structure.degrees(edges)
    return d.select("id", "deg", F.greatest(F.bround(F.col("deg") + laplace(uniform(F.col("id"), seed), 1 / epsilon)), F.lit(0.0)).cast("long").alias("noisy"))


def even_total(degrees: DataFrame) -> DataFrame:
    """Adds 1 to the first node's noisy degree where the sum is odd."""
    odd = degrees.agg((F.sum("noisy") % 2).alias("odd"), F.min("id").alias("first"))
    return degrees.join(F.broadcast(odd), F.lit(True)).select("id", "deg", (F.col("noisy") + F.when(F.col("id") == F.col("first"), F.col("odd")).otherwise(0)).alias("noisy"))


def noisy_histogram(edges: DataFrame, epsilon: float, seed: int = 31) -> DataFrame:
    """(deg, cnt, noisy): Laplace(4 / epsilon) on each bin of the dense degree histogram, rounded, not below 0."""
    h = structure.degree_histogram(edges, dense=True)
    return h.select("deg", "cnt", F.greatest(F.bround(F.col("cnt") + laplace(uniform(F.col("deg"), seed), 4 / epsilon)), F.lit(0.0)).cast("long").alias("noisy"))


def noisy_counts(rows: DataFrame, key, value, epsilon: float, seed: int):
    return rows.withColumn("noisy", laplace_clamped(F.col(value), uniform(key, seed), 1 / epsilon))


def norm_sub(values: DataFrame, column: str = "x") -> DataFrame:
    """Adds y = max(x - shift, 0); the integer shift in [0, -min) brings the sum nearest to the old sum, the least one on ties.
    The sum for a shift s is linear between two neighbouring values, so of each stretch only the two whole numbers beside
    its crossing of the old sum and its ends are tried: work by distinct values, however low the least value is."""
    x = F.col(column)
    total = values.agg(F.coalesce(F.min(x), F.lit(0)).cast("long").alias("low"), F.coalesce(F.sum(x), F.lit(0)).cast("long").alias("total"))
    hist = values.where(x > 0).groupBy(x.cast("long").alias("h")).agg(F.count("*").alias("c"))
    above = Window.orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    # for shifts in [lower, h): n values are above, with sum s
    runs = hist.select("h", F.sum("c").over(above).alias("n"), F.sum(F.col("c") * F.col("h")).over(above).alias("s"), F.coalesce(F.lead("h").over(Window.orderBy(F.desc("h"))), F.lit(0)).alias("lower"))
    top = hist.agg(F.coalesce(F.max("h"), F.lit(0)).alias("h")).select("h", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.col("h").alias("lower")).withColumn("h", F.lit((1 << 62)))
    rows = runs.unionByName(top).crossJoin(F.broadcast(total)).withColumn("last", F.greatest(F.lit(0), -F.col("low") - 1))
    crossing = F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("total"), F.col("n"))), F.col("lower")).cast("long")
    inside = lambda c: F.least(F.greatest(c, F.col("lower")), F.least(F.col("h") - 1, F.col("last")))
    tried = rows.where("lower <= last").withColumn("shift", F.explode(F.array_distinct(F.array(F.col("lower"), inside(crossing), inside(crossing + 1), F.least(F.col("h") - 1, F.col("last"))))))
    tried = tried.withColumn("off", F.abs(F.col("s") - F.col("n") * F.col("shift") - F.col("total")))
    shift = tried.orderBy("off", "shift").limit(1).select("shift")
    return values.join(F.broadcast(shift), F.lit(True)).withColumn("y", F.greatest(x - F.col("shift"), F.lit(0)))


def smooth_sensitivity(edges: DataFrame, beta: float) -> DataFrame:
    """Largest number of triangles through a node (1 at least), times exp(-beta)."""
    return structure.triangles_per_node(edges).agg(F.greatest(F.coalesce(F.max("triangles"), F.lit(0)), F.lit(1)).cast("long").alias("local_sensitivity")).withColumn("smooth", F.col("local_sensitivity") * F.exp(F.lit(-beta)))


def graphical(histogram: DataFrame, degree: str = "deg", cnt: str = "cnt") -> DataFrame:
    """Erdős-Gallai over a histogram of degrees: even sum, and at the end of each run of equal degrees the inequality. What
    the nodes of lower degree can take, min(degree, k), comes from running sums: of degrees up to k, and k for those between."""
    h = histogram.where(F.col(cnt) > 0).select(F.col(degree).cast("long").alias("d"), F.col(cnt).cast("long").alias("c"))
    down = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    runs = h.select("d", F.sum("c").over(down).alias("k"), F.sum(F.col("c") * F.col("d")).over(down).alias("s"))
    sums = h.select("d", F.sum("c").over(up).alias("below"), F.sum(F.col("c") * F.col("d")).over(up).alias("held"))
    # the last degree that is below d and at most k, found by sorting both kinds of rows together
    asked = runs.select(F.least(F.col("k"), F.col("d") - 1).alias("at"), "d", "k", "s", F.lit(1).alias("kind"))
    both = sums.select(F.col("d").alias("at"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("s"), F.lit(0).alias("kind"), "below", "held")
    both = both.unionByName(asked.withColumn("below", F.lit(None).cast("long")).withColumn("held", F.lit(None).cast("long")))
    upto = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.select("*", F.coalesce(F.last("below", True).over(upto), F.lit(0)).alias("b"), F.coalesce(F.last("held", True).over(upto), F.lit(0)).alias("o")).where("kind = 1")
    n = h.agg(F.sum("c").alias("n"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("t", F.col("o") + F.col("k") * (F.col("n") - F.col("k") - F.col("b")))
    return rows.agg(F.coalesce(F.min((F.col("s") <= F.col("k") * (F.col("k") - 1) + F.col("t")).cast("int")), F.lit(1)).alias("ok"), F.coalesce(F.max("s") % 2, F.lit(0)).alias("odd")).select(((F.col("ok") == 1) & (F.col("odd") == 0)).cast("int").alias("graphical"))


def pooled(values: list[float], weights: list[float]) -> list[float]:
    """Non-decreasing fit of least squares: neighbouring blocks that are out of order become one."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [b[0] for b in blocks for _ in range(int(b[2]))]


def isotonic(rows: DataFrame, order: str, value: str, weight: str | None = None) -> DataFrame:
    """Adds fit: the non-decreasing sequence nearest to the values in the given order, half-even rounded in `rounded`. Rows are
    the distinct values of a histogram or sequence; sorted runs are pooled on their own, then their blocks (a run's result is
    a sequence of blocks, never more than its rows) together in one task."""
    import pandas as pd

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    runs = rows.select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), w.alias("w")).repartitionByRange("o").sortWithinPartitions("o")

    def first(frames):
        import pandas as pd

        for pdf in frames:
            if len(pdf):
                fit = pd.Series(pooled(pdf.v.tolist(), pdf.w.tolist()), index=pdf.index)
                yield pdf.assign(fit=fit).groupby("fit", sort=False).agg(o=("o", "min"), last=("o", "max"), w=("w", "sum")).reset_index()[["o", "last", "fit", "w"]]

    kind = dict(rows.select(F.col(order).alias("o")).dtypes)["o"]
    blocks = runs.mapInPandas(first, f"o {kind}, last {kind}, fit double, w double")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        return pdf.assign(fit=pooled(pdf.fit.tolist(), pdf.w.tolist()))[["o", "last", "fit"]]

    steps = blocks.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(join, f"o {kind}, last {kind}, fit double")
    out = rows.join(F.broadcast(steps), F.col(order).between(F.col("o"), F.col("last"))).select(*rows.columns, "fit")
    return out.withColumn("rounded", F.bround("fit").cast("long"))


def gaussian_noise(u: Column, v: Column, sigma: float) -> Column:
    """Of two uniform draws (Box and Muller)."""
    return sigma * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def clipped(vector: Column, most: float = 1.0) -> Column:
    """An array of numbers, scaled down to length `most` where it is longer."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(F.lit(1.0), length / most))


def gumbel_choice(weights: DataFrame, group: str, item: str, weight: str, key: Column, temperature: float = 1.0, stream: int = 601) -> DataFrame:
    """(group, choice): of each group one item by a draw in proportion to exp(weight / temperature), as the highest of the
    weights with Gumbel noise; ties go to the higher item."""
    from ..functions import gumbel

    rate = F.round(F.col(weight) / temperature + gumbel(uniform(key, stream)), 9)
    return weights.groupBy(group).agg(F.max_by(item, F.struct(rate, F.col(item))).alias("choice"))
