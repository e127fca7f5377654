"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Every listed entry is a host and the start of a path; it fits its host and all subdomains. Entries and URLs are brought
to one canonical form: no user, port or last dot of the host, escaped letters, digits and -._~ of the path as they are,
no empty or "." segments. A URL's keys are its host suffixes joined with the starts of its path that have a listed
length. The filter, blocks of 512 bits with 8 bits set in one block for each entry, has a size by the list up to
MOST_BLOCKS and passes the keys that may be listed; the join with the list removes false positives. Executors set the
filter's bits, so a list may have any size; rows without a key that passes never meet the list.

Rules are entries of a higher rank, whose keys are of host and path as they stand.

Defined results: a URL that is null or has no "://" has an empty host and path, and fits nothing. An entry of the
rules outranks the list of URLs, a longer one a shorter one, a later one in the alphabet on ties. An empty list blocks
nothing. Repeated rows are judged one by one; other columns than the id and the URL are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Fixed values: (entry, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words and endings of the sites of the standard list, which is all their combinations.
SITE_WORDS = (("free", "cheap", "adult", "spam", "casino", "ads", "bet", "pills", "hot", "lucky"), ("bets", "pills", "x", "farm", "win", "track", "club", "zone", "deals", "spin"), ("com", "net", "org", "info"))
#: Entries up to which the list is broadcast (about 100 bytes each) for the rows that pass the filter; a larger list is joined by shuffle.
BROADCAST_ENTRIES = 1_000_000
#: 64 bytes each; a list of more than 32 entries a block has a filter that passes more, and the same results.
MOST_BLOCKS = 1_000_000
BITS_PER_ENTRY, SET_BITS, BLOCK_WORDS = 16, 8, 8
#: Begins the keys of rules, which no URL's canonical key does.
RULE_MARK = "\0"
ESCAPED = re.compile(r"%([0-9A-Fa-f]{2})")
KEPT = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path in canonical form; the path begins with a slash."""
    host = re.sub(r":\d*$", "", host.rpartition("@")[2].lower()).rstrip(".")
    path = ESCAPED.sub(lambda m: c if (c := chr(int(m[1], 16))) in KEPT else m[0].upper(), path)
    path = re.sub(r"/(?:\.?/)+", "/", "/" + path)
    return host, path


def canonical_entry(entry: str) -> str:
    """Of a listed URL or of a host and the start of a path, without a query or fragment."""
    rest = re.split(r"[?#]", entry.strip().partition("://")[2] or entry.strip(), maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(canonical(host, slash + path))


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """All suffixes of the host with all starts of the path that have one of the lengths."""
    if not host:
        return []
    labels = host.split(".")
    return [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)]


def key_hash(key: str) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class BlockedBloom:
    """Blocks of eight 64-bit words; an entry sets one bit in each word of its block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, hashes: np.ndarray, blocks: int | None = None) -> BlockedBloom:
        out = cls(np.zeros((blocks or blocks_for(len(hashes)), BLOCK_WORDS), np.uint64))
        block, bits = out._at(hashes)
        for w in range(BLOCK_WORDS):
            np.bitwise_or.at(out.words[:, w], block, bits[:, w])
        return out

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64)
        mixed = (h & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        shifts = mixed[:, None] >> (np.uint64(16) + np.arange(BLOCK_WORDS, dtype=np.uint64) * np.uint64(6)) & np.uint64(63)
        return block, np.uint64(1) << shifts

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self._at(hashes)
        return ((self.words[block] & bits) == bits).all(1)


def parsed(url):
    """Host and path of a URL column, as the contract has them."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, 1 << 30), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, 1 << 30)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def blocks_for(entries: int) -> int:
    return min(MOST_BLOCKS, max(1, -(-entries * BITS_PER_ENTRY // (64 * BLOCK_WORDS))))


def filter_of(entries: DataFrame, n: int) -> BlockedBloom:
    """The filter over the column hash; each task sets bits of its own rows, a block's words are joined by or."""
    blocks = blocks_for(n)
    names = [f"w{i}" for i in range(BLOCK_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = BlockedBloom(np.zeros((blocks, 0), np.uint64))
                block, bits = own._at(b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(bits[:, i].view(np.int64)) for i in range(BLOCK_WORDS))], ["block", *names])

    found = entries.select("hash").mapInArrow(run, "block long, " + ", ".join(f"{x} long" for x in names)).groupBy("block").agg(*[F.bit_or(x).alias(x) for x in names]).toArrow()
    out = BlockedBloom(np.zeros((blocks, BLOCK_WORDS), np.uint64))
    if found.num_rows:
        out.words[found.column("block").to_numpy()] = np.stack([found.column(x).to_numpy().view(np.uint64) for x in names], 1)
    return out


def judge_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """entries: entry string (a URL, or a host and the start of a path), verdict string, is_rule boolean. Per row: id, host,
    path, rule, verdict (of the longest rule, else of the longest listed entry, else allow)."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "urls")

    def canon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [RULE_MARK + x if rule else canonical_entry(x) for x, rule in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), b.column(1), b.column(2), pa.array([len(x) - x.index("/") for x in own], pa.int32()), pa.array([key_hash(x) for x in own], pa.int64())], ["entry", "entry_verdict", "is_rule", "n", "hash"])

    listed = entries.where("entry IS NOT NULL AND trim(entry) <> ''").select(F.col("entry").cast("string"), F.col("verdict").cast("string"), F.coalesce("is_rule", F.lit(False)).alias("is_rule"))
    listed = listed.mapInArrow(canon, "entry string, entry_verdict string, is_rule boolean, n int, hash long").groupBy("entry", "is_rule", "n", "hash").agg(F.max("entry_verdict").alias("entry_verdict"))
    listed = stored(listed, f"{folder}/listed")
    n = listed.count()
    lengths = {k: sorted(r.n for r in listed.where(F.col("is_rule") == k).select("n").distinct().collect()) for k in (True, False)}
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    bloom = spark.sparkContext.broadcast(filter_of(listed, n).words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = BlockedBloom(bloom.value)
        for b in batches:
            own = [[RULE_MARK + k for k in keys_of(h, p, lengths[True])] + keys_of(*canonical(h, p), lengths[False]) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            flat = [k for x in own for k in x]
            passed = held.may_hold(np.array([key_hash(k) for k in flat], np.int64)) if flat else np.zeros(0, bool)
            at, found = 0, []
            for x in own:
                found.append([k for k, ok in zip(x, passed[at : at + len(x)], strict=True) if ok])
                at += len(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], ["id", "host", "path", "keys"])

    # written before it is read twice, so that rows keep their numbers
    rows = rows.mapInArrow(run, "id long, host string, path string, keys array<string>").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, f"{folder}/rows")
    own = F.broadcast(listed) if n <= BROADCAST_ENTRIES else listed
    hits = rows.select("row", F.explode("keys").alias("key")).join(own, F.col("key") == F.col("entry"))
    hits = hits.groupBy("row").agg(F.max(F.struct("is_rule", F.length("entry").alias("size"), "entry", "entry_verdict")).alias("best"))
    best = F.col("best.is_rule")
    out = rows.where(F.size("keys") > 0).join(hits, "row", "left").select("id", "host", "path", F.when(best, F.substring("best.entry", 2, 1 << 30)).alias("rule"), F.coalesce("best.entry_verdict", F.lit("allow")).alias("verdict"))
    return out.unionByName(rows.where(F.size("keys") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))


def standard_entries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rules, and listed URLs: those of a text file of one a line, or all sites made of SITE_WORDS; all are blocked."""
    a, b, tops = SITE_WORDS
    sites = spark.read.text(path).select(F.col("value").alias("entry")) if path else spark.createDataFrame([(f"{x}-{y}.example.{t}/",) for x in a for y in b for t in tops], "entry string")
    rules = spark.createDataFrame([(e, v, True) for e, v in RULES], "entry string, verdict string, is_rule boolean")
    return rules.unionByName(sites.select("entry", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
