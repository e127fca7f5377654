"""Graphs from text files and from tables; graphs to text and CSV files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _parsed(spark: SparkSession, path: str, comment: str | None) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    return lines.select(F.split("line", r"\s+").alias("p"))


def read_edges(spark: SparkSession, path: str, comment: str | None = "#", strict: bool = True, keep_loops: bool = True) -> DataFrame:
    """u <= v, distinct. strict: a line without exactly two integers makes the whole graph empty; otherwise only lines of
    fewer than two are passed over. A line that isn't integers empties the graph in both."""
    rows = _parsed(spark, path, comment)
    if not strict:
        rows = rows.where(F.size("p") >= 2)
    rows = rows.select(F.try_element_at("p", F.lit(1)).try_cast("long").alias("a"), F.try_element_at("p", F.lit(2)).try_cast("long").alias("b"), F.size("p").alias("n"))
    bad = F.col("a").isNull() | F.col("b").isNull() | ((F.col("n") != 2) if strict else F.lit(False))
    broken = rows.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("broken"))
    edges = rows.join(F.broadcast(broken.where("broken = 0")), F.lit(True)).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return (edges if keep_loops else edges.where("u <> v")).distinct()


def read_weighted_edges(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(u, v, weight) with a third column of weights, 1.0 where it is missing; repeated edges add up."""
    rows = _parsed(spark, path, comment).where(F.size("p") >= 2)
    a, b = F.col("p")[0].cast("long"), F.col("p")[1].cast("long")
    w = F.coalesce(F.try_element_at("p", F.lit(3)).try_cast("double"), F.lit(1.0))
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), w.alias("w")).groupBy("u", "v").agg(F.sum("w").alias("weight"))


def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together: distinct (u, v), u < v. The join stays within an order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("p"))
    a, b = items.withColumnRenamed("p", "u"), items.withColumnRenamed("p", "v")
    return a.join(b, "l_orderkey").where("u < v").select("u", "v").distinct()


def order_chain(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """Customers whose orders follow each other on a day (and in a priority): (u, v, weight), u < v, the weight is how often."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderpriority") if by_priority else F.lit("")).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    pairs = followed(orders, ["day", "part"], "k", "c")
    return pairs.where("c <> next").groupBy(F.least("c", "next").alias("u"), F.greatest("c", "next").alias("v")).agg(F.count("*").alias("weight"))


def followed(rows: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """(value, next): each row with the next one of its group. Rows are dealt in sorted runs, so a group of any size is
    spread over tasks; the first row of each run (one row a run) closes the gap to the run before."""
    from ..session import cut_lineage

    keys = [*groups, order]
    runs = cut_lineage(rows.repartitionByRange(*keys).withColumn("run", F.spark_partition_id()))
    place, here = F.struct(*keys), F.struct(*groups, F.col(value).alias("value"))
    first = runs.groupBy("run").agg(F.min_by(here, place).alias("head"))
    first = first.select("run", F.lead("head").over(Window.orderBy("run")).alias("head"))
    inside = runs.withColumn("next", F.lead(here).over(Window.partitionBy("run").orderBy(*keys)))
    out = inside.join(F.broadcast(first), "run").withColumn("next", F.coalesce("next", "head"))
    same = F.lit(True)
    for g in groups:
        same = same & (F.col(g) == F.col(f"next.{g}"))
    return out.where(same).select(value, F.col("next.value").alias("next"))


def user_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events follow each other within an hour of a day: a denser graph."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_trunc("hour", "ts").alias("hour")).distinct()
    a, b = events.withColumnRenamed("user_id", "u"), events.withColumnRenamed("user_id", "v")
    return a.join(b, "hour").where("u < v").select("u", "v").distinct()


#: Users of a block; a task holds a bit for each pair of users of two blocks.
BLOCK_USERS = 1 << 14


def transition_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, later): of the graph of user_transitions the number of edges (u, v) of each u that has any. Pairs are bits that tasks
    count, for each two blocks of users, and are never written: their number grows with the square of the users."""
    from ..operators import structure
    from ..session import cut_lineage

    events = cut_lineage(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_trunc("hour", "ts").alias("hour")).dropna().distinct())
    users = cut_lineage(structure.ranked(events.select("user_id").distinct(), "user_id"))
    placed = events.join(users, "user_id").select("hour", F.floor(F.col("idx") / BLOCK_USERS).alias("block"), (F.col("idx") % BLOCK_USERS).cast("short").alias("k"))
    hours = placed.groupBy("hour", "block").agg(F.collect_set("k").alias("ks"))
    blocks = max(1, -(-users.count() // BLOCK_USERS))
    # each block is the left side of the tasks (block, b), b >= block, and the right side of the tasks (a, block), a <= block
    sides = F.transform(F.sequence(F.col("block"), F.lit(blocks - 1).cast("long")), lambda b: F.struct(F.col("block").alias("a"), b.alias("b"), F.lit(True).alias("left")))
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("block")), lambda a: F.struct(a.alias("a"), F.col("block").alias("b"), F.lit(False).alias("left")))
    rows = hours.select("hour", "ks", F.explode(F.concat(sides, other)).alias("x")).select(F.unix_micros("hour").alias("hour"), "ks", "x.a", "x.b", "x.left")

    def count(table):
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        hour, left, lists = table.column("hour").to_numpy(), table.column("left").to_numpy(zero_copy_only=False), table.column("ks").combine_chunks()
        own = lambda i: lists[i].values.to_numpy().astype(np.int64)
        right = {int(hour[i]): i for i in np.flatnonzero(~left)}
        met = np.zeros((BLOCK_USERS, BLOCK_USERS // 64), np.uint64)
        for i in np.flatnonzero(left).tolist():
            if int(hour[i]) in right:
                bits = np.zeros(BLOCK_USERS, np.uint8)
                bits[own(right[int(hour[i])])] = 1
                met[own(i)] |= np.packbits(bits, bitorder="little").view(np.uint64)
        if a == b:  # only those after each
            k, word = np.arange(BLOCK_USERS), np.arange(BLOCK_USERS // 64)
            met[word[None, :] < (k // 64)[:, None]] = 0
            met[k, k // 64] &= ~np.uint64(0) << (k % 64).astype(np.uint64) << np.uint64(1)
        later = np.bitwise_count(met).sum(1, dtype=np.int64)
        some = np.flatnonzero(later)
        return pa.table({"idx": pa.array(some + a * BLOCK_USERS, pa.int64()), "later": pa.array(later[some])})

    tasks = blocks * (blocks + 1) // 2
    found = rows.repartition(min(tasks, 4 * spark.sparkContext.defaultParallelism), "a", "b").groupBy("a", "b").applyInArrow(count, "idx long, later long")
    return found.groupBy("idx").agg(F.sum("later").alias("later")).join(users, "idx").select(F.col("user_id").alias("u"), "later")


def write_edges(edges: DataFrame, path: str, sep: str = " ", header: bool = False) -> None:
    edges.select("u", "v").orderBy("u", "v").write.mode("overwrite").csv(path, sep=sep, header=header)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(u, v), u <= v, distinct, from binary files: the number of nodes (int32), for each node the number of links up to and
    with it (int64), the links' ends (int32), all little-endian. A file is read by one task, as its links have no names."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                n = int(np.frombuffer(data, "<i4", 1)[0])
                ends = np.frombuffer(data, "<i8", n, 4)
                to = np.frombuffer(data, "<i4", int(ends[-1]) if n else 0, 4 + 8 * n).astype(np.int64)
                src = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends, prepend=0))
                for i in range(0, len(to), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(src[i : i + (1 << 20)]), pa.array(to[i : i + (1 << 20)])], ["a", "b"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "a long, b long")
    return rows.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def write_results(df: DataFrame, path: str) -> None:
    """Detailed results, nested columns kept, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def append_runs(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of runs."""
    rows.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def load_method(path: str, name: str):
    """A function (edges, n, epsilon) -> edges of a Python file, for the registry; what goes wrong is raised."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("veilgraph_plugin", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)
