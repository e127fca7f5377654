"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words everywhere in this subpackage: space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Characters of text that go to one Arrow batch of results at most.
BATCH_CHARS = 4_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share. Unset, a temporary one serves a local master
    (tests), where all is one machine; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


_remembered: dict[tuple, object] = {}


def give_back() -> None:
    """Gives the system what this Python worker no longer needs of earlier tasks, and what it remembers of them."""
    _remembered.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def forget() -> None:
    """Gives back what this Python worker remembers of earlier tasks, if anything."""
    if _remembered:
        give_back()


def remembered(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: of one operator at a time, so that stages in a row don't add up."""
    if key not in _remembered:
        give_back()
        _remembered[key] = make()
    return _remembered[key]


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and lost executors don't lose it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that other columns, whatever their names, are never read."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def rows_of(batches: Iterable[pa.RecordBatch], most: int = BATCH_CHARS) -> Iterator[tuple[list, list]]:
    """(ids, texts) of bounded size from batches with the columns id and text."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most:
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], texts[start:]


def fresh(name: str, columns: Iterable[str]) -> str:
    """A column name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts_of(batches: Iterable[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts, in the given column, have about most bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def crc32_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))
