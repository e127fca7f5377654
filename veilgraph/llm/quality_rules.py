"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures of a text: word and character counts, symbols, stop words, repeated lines, repeated 8-word windows. A rule
names a ratio and its bounds; verdict() compiles all rules into one boolean expression, so the planner sees a
projection over the scan and nothing else: no shuffle, no user function.

Defined results: null, empty and blank texts have no words, and fail (n_words < 20). Repeated rows and equal or null
ids are judged row by row. Input columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on with as be at by this from are "
    "le la les de des du et un une en que qui dans pour par sur est au "
    "der die das und von den dem mit ist im nicht ein eine zu sich auf für als "
    "el los las y del se por con para su lo no"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie in [low, high]; a denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float = 0.0
    high: float = float("inf")


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("shouted_marks_per_word", "n_marks", "n_words", 0.0, 0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02),
    Rule("repeated_lines_per_line", "n_dup_lines", "n_lines", 0.0, 0.3),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measures, all long."""
    text = F.col("text")
    words = F.array_remove(F.split(text, SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = id_text(docs, id_col, text_col).select("id", "text", words.alias("words"), lines.alias("lines"))
    windows = F.size("words") - (WINDOW - 1)
    hashes = F.when(windows > 0, F.transform(F.sequence(F.lit(1), windows), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    left = F.length(F.regexp_replace("text", f"[^{SYMBOLS}!]+", ""))
    marks = F.length(F.regexp_replace("text", "[^!]+", ""))
    counted = split.select(
        "id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (left - marks).cast("long").alias("n_symbols"), marks.cast("long").alias("n_marks"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    # only a text with two windows of one hash pays for the sort below
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ranked = counted.withColumn("ranked", F.when(twice, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice("words", a["i"] + 1, WINDOW) == F.slice("words", b["i"] + 1, WINDOW))

    def repeated(x: Column, j: Column) -> Column:
        return F.coalesce(same(x, F.get("ranked", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("ranked", j + 1)), F.lit(False))

    found = ranked.withColumn("found", F.array_sort(F.transform(F.filter("ranked", repeated), lambda x: x["i"])))
    # a repeated window adds the words up to the next repeated window, WINDOW at most
    covered = F.aggregate(F.transform("found", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("found", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return found.select("id", "n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One expression: every rule holds."""
    out = F.lit(True)
    for r in rules:
        top, under = F.col(r.numerator).cast("double"), F.col(r.denominator)
        held = top >= r.low * under
        if r.high != float("inf"):
            held = held & (top <= r.high * under)
        out = out & held
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
