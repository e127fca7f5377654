"""Attacks on tables: quasi-identifiers in bins, codes, imputation, linkage, and models that guess membership or a secret."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import draw


@dataclass(frozen=True)
class Column:
    """What is known of a column: its kind, its bounds and bins if it is a number, its values if it is not."""

    name: str
    kind: str  # "number" or "category"
    low: float = 0.0
    high: float = 1.0
    bins: int = 10
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Metadata:
    columns: tuple[Column, ...]

    @classmethod
    def of(cls, df: DataFrame, numbers: list[str], categories: list[str], bins: int = 10) -> Metadata:
        """Read from the table, in one pass."""
        low_high = [F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in numbers]
        row = df.agg(*low_high, *[F.array_sort(F.collect_set(c)).alias(c) for c in categories]).first()
        columns = [Column(c, "number", row[c]["low"] or 0.0, row[c]["high"] or 0.0, bins) for c in numbers] + [Column(c, "category", values=tuple(map(str, row[c]))) for c in categories]
        return cls(tuple(columns))


def binned(df: DataFrame, meta: Metadata) -> DataFrame:
    """Numbers become the number of their bin, from 0; values outside the bounds go to the first or last one; nulls stay."""
    out = df
    for c in meta.columns:
        if c.kind == "number":
            width = (c.high - c.low) / c.bins or 1.0
            bin_ = F.floor((F.col(c.name).cast("double") - c.low) / width)
            out = out.withColumn(c.name, F.when(F.col(c.name).isNotNull(), F.least(F.greatest(bin_, F.lit(0)), F.lit(c.bins - 1))).cast("long"))
    return out


def coded(df: DataFrame, meta: Metadata) -> DataFrame:
    """Categories become their place among the values; a null or unknown one is the place after the last."""
    out = df
    for c in meta.columns:
        if c.kind == "category":
            place = F.array_position(F.array(*map(F.lit, c.values)), F.col(c.name).cast("string"))
            out = out.withColumn(c.name, F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(c.values)).cast("long"))
    return out


def imputed(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Nulls of numbers become the median, those of categories the most frequent value (the least on ties)."""
    fills = df.agg(*[F.median(c).alias(c) for c in numbers]).withColumn("__one", F.lit(1)) if numbers else df.sparkSession.range(1).select(F.lit(1).alias("__one"))
    for c in categories:
        mode = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), c)).alias(c))
        fills = fills.crossJoin(mode)
    fills = fills.select(*[F.col(c).alias(f"__fill_{c}") for c in (*numbers, *categories)])
    return df.crossJoin(F.broadcast(fills)).select(*[F.coalesce(F.col(c).cast("double") if c in numbers else F.col(c), F.col(f"__fill_{c}")).alias(c) if c in numbers or c in categories else F.col(c) for c in df.columns])


class PrivacyAttack(ABC):
    """Learns on what an attacker has, then answers for targets."""

    @abstractmethod
    def train(self, *args, **kwargs) -> PrivacyAttack: ...

    @abstractmethod
    def attack(self, targets: DataFrame) -> DataFrame: ...


#: Classifiers by name; nearest neighbours and a radial kernel have no counterpart in MLlib: the former is nearest() below, the latter is left out.
CLASSIFIERS = {
    "LogisticRegression": lambda n: LogisticRegression(maxIter=100),
    "LinearSVC": lambda n: LinearSVC(maxIter=100),
    "RandomForest": lambda n: RandomForestClassifier(numTrees=50, maxDepth=10, seed=42),
    "MLP": lambda n: MultilayerPerceptronClassifier(layers=[n, 32, 2], maxIter=200, seed=42),
}


def features_pipeline(numbers: list[str], categories: list[str]) -> list:
    """Indexed and one-hot categories beside scaled numbers; values that training has not are kept as their own class."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__h" for c in categories], dropLast=False)] if categories else []
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"{c}__h" for c in categories]], outputCol="__raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=False, withStd=True))
    return stages


class MembershipClassifier(PrivacyAttack):
    """Tells by a classifier whether a row's table was made with the target; a target whose quasi-identifiers only it has is
    found without one."""

    def __init__(self, numbers: list[str], categories: list[str], quasi: list[str] | None = None, classifier: str = "RandomForest"):
        self.numbers, self.categories, self.quasi, self.classifier = numbers, categories, quasi or [], classifier

    def train(self, rows: DataFrame, label: str = "label") -> MembershipClassifier:
        stages = features_pipeline(self.numbers, self.categories)
        first = Pipeline(stages=stages).fit(rows)
        width = len(first.transform(rows).select("features").first()[0])
        data = first.transform(rows).withColumn("label", F.col(label).cast("double"))
        self.model = (first, CLASSIFIERS[self.classifier](width).setFeaturesCol("features").setLabelCol("label").fit(data))
        self.sizes = rows.groupBy(*self.quasi).agg(F.count("*").alias("group_size")) if self.quasi else None
        return self

    def attack(self, targets: DataFrame) -> DataFrame:
        """The targets with guess (0 or 1) and confidence of 1; linked where the group has one row."""
        out = self.model[1].transform(self.model[0].transform(targets))
        p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        out = out.select(*targets.columns, F.col("prediction").cast("int").alias("guess"), p.alias("confidence"))
        if self.sizes is None:
            return out.withColumn("linked", F.lit(False))
        out = out.join(self.sizes, self.quasi, "left").withColumn("linked", F.coalesce(F.col("group_size") == 1, F.lit(False)))
        return out.withColumn("guess", F.when(F.col("linked"), 1).otherwise(F.col("guess"))).withColumn("confidence", F.when(F.col("linked"), 1.0).otherwise(F.col("confidence"))).drop("group_size")


def shadow_splits(rows: DataFrame, key: str, shadows: int, size: int, stream: int = 501) -> DataFrame:
    """(shadow, ...): for each shadow `size` rows by draw; of like size whatever the shadow, and drawn anew for each."""
    from .worlds import first_of_each

    each = rows.withColumn("shadow", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shadows - 1).cast("long")))).withColumn("__limit", F.lit(size))
    return first_of_each(each, "shadow", draw(F.col(key) * 8191 + F.col("shadow"), stream), key, "__limit").drop("__limit")


def shadow_data(rows: DataFrame, key: str, targets: DataFrame, shadows: int, size: int, sanitise=None) -> DataFrame:
    """(shadow, label, ...): each shadow without the targets (label 0) and with them in place of so many rows (label 1); what
    sanitise makes of them, if given, e.g. a table with noise or bins."""
    out = shadow_splits(rows.join(targets.select(key), key, "left_anti"), key, shadows, size)
    more = targets.select(*rows.columns).withColumn("shadow", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shadows - 1).cast("long"))))
    rank = F.row_number().over(Window.partitionBy("shadow").orderBy(key))
    count = targets.count()
    with_them = out.withColumn("__r", rank).where(F.col("__r") > count).drop("__r").unionByName(more).withColumn("label", F.lit(1))
    both = out.withColumn("label", F.lit(0)).unionByName(with_them)
    return sanitise(both) if sanitise else both


def _closest(x: np.ndarray, y: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of rows (x, y) the k of least (distance, y) to each target t, for one number: (place in t, distance, y). Only what lies
    next to a target on either side is met, and further rows as long as they are as near as the k-th."""
    sides = []
    for sign in (1, -1):  # at or above the target, and below it
        order = np.lexsort((y, sign * x))
        v, label = x[order], y[order]
        run = np.flatnonzero(np.diff(v, prepend=np.nan) != 0)
        nth = np.arange(len(v)) - np.repeat(run, np.diff(np.append(run, len(v))))
        v, label = v[nth < k], label[nth < k]
        sides.append((v, label, np.searchsorted(v, t) if sign > 0 else np.searchsorted(-v, -t, "right")))
    width = k
    while True:
        d, own, more = [], [], []
        for v, label, start in sides:
            at = start[:, None] + np.arange(width)
            here = at < len(v)
            at = np.minimum(at, len(v) - 1)
            d.append(np.where(here, (v[at] - t[:, None]) ** 2, np.nan))
            own.append(label[at])
            more.append(start + width < len(v))
        both, labels = np.concatenate(d, 1), np.concatenate(own, 1)
        limit = np.sort(both, 1)[:, k - 1]
        if not any((m & (s[:, -1] <= limit)).any() for m, s in zip(more, d, strict=True)):
            break
        width *= 2
    order = np.lexsort((labels, both))[:, :k]
    both, labels = np.take_along_axis(both, order, 1), np.take_along_axis(labels, order, 1)
    place, _ = used = np.nonzero(~np.isnan(both))
    return place, both[used], labels[used]


def _closest_of_all(x: np.ndarray, y: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The same for several numbers, against all rows."""
    out = []
    for i in range(0, len(t), 64):
        d = sum(((x[:, c] - t[i : i + 64, None, c]) ** 2 for c in range(x.shape[1])), 0.0)
        place, at = np.nonzero(d <= (np.partition(d, k - 1, 1)[:, k - 1 : k] if k < len(x) else np.inf))
        own, label = d[place, at], y[at]
        order = np.lexsort((label, own, place))
        place, own, label = place[order], own[order], label[order]
        first = np.arange(len(place)) - np.searchsorted(place, place) < k
        out.append((place[first] + i, own[first], label[first]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def nearest(rows: DataFrame, targets: DataFrame, numbers: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """(key, guess): the mean label of the k rows nearest to each target, ties by label. The targets are the stated queries.
    Rows and targets without one of the numbers are left out."""
    asked = targets.select(F.col(key).alias("__q"), *[F.col(c).cast("double").alias(f"__{c}") for c in numbers]).dropna(subset=[f"__{c}" for c in numbers])
    table = asked.toArrow()
    name = asked.schema["__q"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), np.stack([table.column(i + 1).to_numpy() for i in range(len(numbers))], 1)))
    # rows that are alike count at most k times
    alike = rows.select(*[F.col(c).cast("double").alias(f"__{c}") for c in numbers], F.col(label).cast("double").alias("__y")).dropna()
    alike = alike.groupBy(*alike.columns).agg(F.least(F.count("*"), F.lit(k)).alias("n"))

    def run(batches):
        own = [b for b in batches if b.num_rows]
        names, t = held.value
        if not own or not len(t):
            return
        part = pa.Table.from_batches(own)
        times = part.column(len(numbers) + 1).to_numpy()
        x, y = (np.repeat(v, times, 0) for v in (np.stack([part.column(i).to_numpy() for i in range(len(numbers))], 1), part.column(len(numbers)).to_numpy()))
        for i in range(0, len(t), 4096):
            place, d, labels = _closest(x[:, 0], y, t[i : i + 4096, 0], k) if len(numbers) == 1 else _closest_of_all(x, y, t[i : i + 4096], k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(place + i)), pa.array(d), pa.array(labels)], ["q", "d", "y"])

    near = alike.mapInArrow(run, f"q {name}, d double, y double").groupBy("q").agg(F.expr(f"slice(array_sort(collect_list(struct(d, y))), 1, {k})").alias("n"))
    return near.select(F.col("q").alias(key), F.expr("aggregate(n, 0D, (a, x) -> a + x.y) / size(n)").alias("guess"))


class LinearReconstruction(PrivacyAttack):
    """Ordinary least squares of a secret number on known ones, from sums alone, and the likelihood of each possible value."""

    def __init__(self, known: list[str], secret: str):
        self.known, self.secret = known, secret

    def train(self, rows: DataFrame) -> LinearReconstruction:
        import numpy as np

        names = [F.lit(1.0), *[F.col(c).cast("double") for c in self.known]]
        y = F.col(self.secret).cast("double")
        cells = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)] + [F.sum(a * y).alias(f"y{i}") for i, a in enumerate(names)]
        r = rows.dropna(subset=[*self.known, self.secret]).agg(*cells, F.sum(y * y).alias("yy"), F.count("*").alias("n")).first()
        k = len(names)
        x = np.array([[r[f"x{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        v = np.array([r[f"y{i}"] or 0.0 for i in range(k)])
        self.coefficients = np.linalg.lstsq(x, v, rcond=None)[0]
        rest = max(float((r.yy or 0.0) - self.coefficients @ v), 0.0)
        self.sigma = math.sqrt(rest / max(1, r.n - k))
        return self

    def attack(self, targets: DataFrame) -> DataFrame:
        """The targets with predicted, and likelihood: the density of the true value under the fit."""
        p = sum((float(b) * F.col(c).cast("double") for b, c in zip(self.coefficients[1:], self.known, strict=True)), F.lit(float(self.coefficients[0])))
        s = max(self.sigma, 1e-12)
        density = F.exp(-F.pow(F.col(self.secret).cast("double") - F.col("predicted"), F.lit(2.0)) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
        return targets.withColumn("predicted", p).withColumn("likelihood", density)


class ForestReconstruction(PrivacyAttack):
    """A forest that guesses a secret category; rows whose quasi-identifiers are unique are read off."""

    def __init__(self, numbers: list[str], categories: list[str], secret: str, quasi: list[str] | None = None):
        self.numbers, self.categories, self.secret, self.quasi = numbers, categories, secret, quasi or []

    def train(self, rows: DataFrame) -> ForestReconstruction:
        label = StringIndexer(inputCol=self.secret, outputCol="label", stringOrderType="alphabetAsc")
        self.labels = label.fit(rows)
        self.model = Pipeline(stages=[*features_pipeline(self.numbers, self.categories), RandomForestClassifier(numTrees=50, maxDepth=10, seed=42)]).fit(self.labels.transform(rows))
        self.known = rows.groupBy(*self.quasi).agg(F.count("*").alias("group_size"), F.min(self.secret).alias("read")) if self.quasi else None
        return self

    def attack(self, targets: DataFrame) -> DataFrame:
        out = self.model.transform(targets)
        names = F.array(*map(F.lit, self.labels.labels))
        out = out.select(*targets.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("guess"), F.array_max(vector_to_array("probability")).alias("confidence"))
        if self.known is None:
            return out.withColumn("linked", F.lit(False))
        out = out.join(self.known, self.quasi, "left").withColumn("linked", F.coalesce(F.col("group_size") == 1, F.lit(False)))
        return out.withColumn("guess", F.when(F.col("linked"), F.col("read")).otherwise(F.col("guess"))).withColumn("confidence", F.when(F.col("linked"), 1.0).otherwise(F.col("confidence"))).drop("group_size", "read")
