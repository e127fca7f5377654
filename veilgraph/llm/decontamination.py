"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage in k = floor(EDIT_RATE * n) edits. Cut into k + 1 pieces, one
piece at least must occur unchanged, so an Aho-Corasick automaton over all pieces finds every place where the item
may stand; Myers' bit-parallel distance then decides. Texts and items are compared in lower case with each run of
white space as one space.

The items come to the driver in blocks of at most BLOCK_CHARS characters; each block is broadcast and meets all rows
in a pass of its own, so the benchmark may have any size.

Items of fewer than MIN_CHARS characters match at word boundaries alone: what they match neither begins nor ends
inside a run of letters and digits.

Defined results: null and empty texts and null and empty items match nothing. Repeated rows are judged one by one, equal items each by their own id. Other columns than id and text are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, remembered

EDIT_RATE, MIN_CHARS, BLOCK_CHARS = 0.06, 24, 16_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance between a pattern and any part of a text, bit-parallel over the pattern."""

    def __init__(self, pattern: str):
        self.n, self.at = len(pattern), {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def within(self, text: str, budget: int) -> bool:
        n, last, full = self.n, 1 << self.n - 1, (1 << self.n) - 1
        plus, minus, score = full, 0, n
        for c in text:
            eq = self.at.get(c, 0)
            x = eq | minus
            d = ((eq & plus) + plus ^ plus) | eq | minus
            up, down = minus | ~(d | plus) & full, plus & d
            score += bool(up & last) - bool(down & last)
            if score <= budget:
                return True
            up = up << 1 & full  # the text may start anywhere: no carry into the first row
            down = down << 1 & full
            plus, minus = down | ~(x | up) & full, up & x
        return False


def bounded(text: str, at: int) -> bool:
    """Whether no word goes on across the place."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def within_words(item: str, text: str, start: int, budget: int) -> bool:
    """Whether a part of the text from word boundary to word boundary, near start, differs from the item in budget edits."""
    ends = [e for e in range(start + len(item) - budget, start + len(item) + budget + 1) if 0 < e <= len(text) and bounded(text, e)]
    for a in range(max(0, start - budget), start + budget + 1) if ends else ():
        if bounded(text, a) and any(a < e and abs(e - a - len(item)) <= budget and (text[a:e] == item or budget and distance(item, text[a:e]) <= budget) for e in ends):
            return True
    return False


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, self.min_chars, places = [], min_chars, {}
        for item_id, text in items:
            if text := normal(text or ""):
                budget = int(rate * len(text))
                for offset, piece in pieces(text, budget):
                    places.setdefault(piece, []).append((len(self.items), offset, len(piece)))
                self.items.append((item_id, text, budget, Myers(text)))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, hits in places.items():
            self.automaton.add_word(piece, hits)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[int]:
        """Ids of the items that the text holds, ascending."""
        if not self.automaton or not text:
            return []
        text, found, starts = normal(text), set(), {}
        for end, hits in self.automaton.iter(text):
            for at, offset, size in hits:
                if at not in found:
                    start = end + 1 - size - offset
                    if start >= 0 and len(self.items[at][1]) >= self.min_chars and text.startswith(self.items[at][1], start):
                        found.add(at)
                    else:
                        starts.setdefault(at, set()).add(start)
        for at, places in starts.items():
            if at in found:
                continue
            _, item, budget, myers = self.items[at]
            if len(item) < self.min_chars:
                if any(within_words(item, text, start, budget) for start in places):
                    found.add(at)
                continue
            # windows that overlap are read once, however often a piece repeats
            low = high = None
            for start in [*sorted(places), None]:
                if start is not None and low is not None and start - budget <= high:
                    high = start + len(item) + budget
                    continue
                if low is not None and myers.within(text[low:high], budget):
                    found.add(at)
                    break
                if start is not None:
                    low, high = max(0, start - budget), start + len(item) + budget
        return sorted(self.items[at][0] for at in found)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, keep: list[str] | None = None, out_id: str = "id", out_col: str = "item_ids") -> DataFrame:
    """Per row: out_id, the columns in keep, out_col (ids of items, array of long, ascending)."""
    spark, kept = docs.sparkSession, keep or []
    own_id, own_text, own_items = fresh("own_id", kept), fresh("own_text", kept), fresh("own_items", kept)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{id_col}`").cast("long").alias(own_id), F.col(f"`{text_col}`").cast("string").alias(own_text))
    rows = rows.withColumn(own_items, F.array().cast("array<long>"))
    for block in blocks(benchmark, item_id, item_text):
        held, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            matcher = remembered(("items", key), lambda: Matcher(held.value, rate))
            for b in batches:
                texts, before = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist()
                found = [sorted({*x, *matcher.find(t.as_py() or "")}) for x, t in zip(before, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=b.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(F.col(f"`{own_id}`").alias(out_id), *[F.col(f"`{c}`") for c in kept], F.col(f"`{own_items}`").alias(out_col))
