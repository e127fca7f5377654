"""Near duplicates: all pairs of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Each text's shingles are hashed to 64 bits; packed blocks of (shingle, document) go to the shingle's bucket, which
   knows then in how many documents each occurs. Shingles of one document alone can't link it, so only the others
   come back, and only documents in which they are at least 0.8 of the set stay (all others are done).
2. Token-combination prefixes: the shared shingles of a document stand in one global order, rare ones first. Two
   linked documents have K shingles in common within their prefixes extended by K - 1. Of those, rare shingles
   (document frequency up to FREQUENT) are index keys alone, frequent ones in combinations of K. A document with more
   than MOST_COMBINED frequent shingles in its prefix indexes them singly; the others index theirs so too, marked
   weak, and a key that only weak entries hold is left out, because combinations cover it.
3. Verification is exact on the shared shingles. As only the classes are asked for, documents of a key are compared
   with one leader of its largest class first, ROUNDS times with leaders and classes anew; then, for the keys that
   still hold more than one class, everything outside the largest class is compared with all that is in another class.
   There a parity map tells most pairs that are no links: each shingle flips one of SIGN_BITS bits, so two sets differ
   in at least as many shingles as their maps do in bits, and a link allows (m + n) / 9 of them.
   No link between classes is lost, and a large group of copies costs a few comparisons a document.

Shingles count as equal if 43 bits of their hashes agree within a bucket; documents have no false neighbour for it
but by an accident of about 1 in 10**8 a pair.

Defined results: null, empty and wordless texts have no shingles and link with nothing. Repeated rows are rows of one
class. A null id is ignored where the smallest id of a class is taken. An empty table gives an empty result. Other
columns than id and text are not read. A batch task's memory is bounded by its block; a bucket holds 6 bytes for each
occurrence of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_shuffles, id_text, remove, rows_of, shared_dir, stored

SHINGLE, K = 5, 2
BUCKET_BITS = 11
FREQUENT, MOST_COMBINED, ROUNDS = 16, 24, 3
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 60_000
REMEMBERED = 400_000
SIGN_BITS = 512
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Distinct hashes, ascending. bytes.split() cuts at space and U+0009..U+000D, bytes.lower() maps A-Z alone."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        try:
            h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = out + mixed(h[k : len(h) - n + 1 + k] + _FACTORS[k]) * _FACTORS[k]
        return np.unique(mixed(out))


def needed(n: int) -> int:
    """Least overlap of a linked set of n shingles."""
    return -(-80 * n // 100)


def _postings(batches: Iterator[pa.RecordBatch], block_shingles: int) -> Iterator[pa.RecordBatch]:
    """Per block of documents: its shingles by bucket, and a row (meta) with ids and set sizes."""
    forget()
    own, part, number = Shingler(), TaskContext.get().partitionId(), 0
    ids, sets, size = [], [], 0

    def block() -> Iterator[pa.RecordBatch]:
        name = part << 32 | number
        lengths = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets)), lengths).astype(np.uint16)
        bucket = (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, low, at = bucket[order], (tokens[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << BUCKET_BITS)) if len(bucket) else np.zeros(1, int)
        rows = [(int(bucket[a]), low[a:b].tobytes() + at[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        known = np.array([x if x is not None else 0 for x in ids], np.int64)
        meta = np.array([x is not None for x in ids], np.uint8).tobytes() + known.tobytes() + lengths.tobytes()
        # a row with an odd number of bytes a posting can't be: meta rows stand in a column of their own
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([*(r[0] for r in rows), name % (1 << BUCKET_BITS)], pa.int32()), "block": pa.array([name] * (len(rows) + 1), pa.int64()),
            "data": pa.array([*(r[1] for r in rows), None], pa.binary()), "meta": pa.array([*[None] * len(rows), meta], pa.binary()),
        })

    for some_ids, texts in rows_of(batches):
        for i, t in zip(some_ids, texts, strict=True):
            ids.append(i)
            sets.append(own.shingles(t))
            size += len(sets[-1])
            if size >= block_shingles or len(ids) >= BLOCK_DOCS:
                yield from block()
                ids, sets, size, number = [], [], 0, number + 1
    if ids:
        yield from block()


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: to each block its shingles that two or more documents hold, with their document frequency."""
    forget()
    blocks, datas, metas = (table.column(c).to_pylist() for c in ("block", "data", "meta"))
    out: list[tuple] = [(b, None, None, m) for b, m in zip(blocks, metas, strict=True) if m is not None]
    rows = [(b, d) for b, d in zip(blocks, datas, strict=True) if d is not None]
    if rows:
        bucket = table.column("bucket")[0].as_py()
        sizes = [len(d) // 6 for _, d in rows]
        tokens = np.concatenate([np.frombuffer(d, np.uint32, n) for (_, d), n in zip(rows, sizes, strict=True)])
        at = np.concatenate([np.frombuffer(d, np.uint16, n, 4 * n) for (_, d), n in zip(rows, sizes, strict=True)])
        row = np.repeat(np.arange(len(rows)), sizes)
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        df = counts[inverse]
        keep = np.flatnonzero(df > 1)
        edges = np.searchsorted(row[keep], np.arange(len(rows) + 1))
        for i, (b, _) in enumerate(rows):
            k = keep[edges[i] : edges[i + 1]]
            if len(k):
                out.append((b, bucket, tokens[k].tobytes() + at[k].tobytes() + df[k].astype(np.uint32).tobytes(), None))
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary()), "meta": pa.array([x[3] for x in out], pa.binary())})


def parity(tokens: np.ndarray) -> np.ndarray:
    """SIGN_BITS bits as 64-bit integers: each shingle flips the bit of its hash."""
    at = (mixed(tokens + _FACTORS[1]) % np.uint64(SIGN_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SIGN_BITS) & 1).astype(np.uint8)).view(np.int64)


def _keys(tokens: np.ndarray, df: np.ndarray, n: int, frequent_from: int, most_combined: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a document's shared shingles, which stand in the global order; how many shingles stand from the key's
    first one on; which keys are strong. If the key's shingles are the first that two documents share, no more than the
    lesser of their rests is common."""
    rest = len(tokens) - np.arange(len(tokens))
    prefix = slice(0, len(tokens) - needed(n) + K)
    tokens, df, rest = tokens[prefix], df[prefix], rest[prefix]
    rare = df <= frequent_from
    frequent, rest_frequent = tokens[~rare], rest[~rare]
    keys, rests, strong = [tokens[rare]], [rest[rare]], [np.ones(int(rare.sum()), bool)]
    if len(frequent):
        few = len(frequent) <= most_combined
        keys.append(frequent)
        rests.append(rest_frequent)
        strong.append(np.full(len(frequent), not few))
        if few and len(frequent) >= K:
            a, b = np.triu_indices(len(frequent), 1)
            keys.append(mixed(frequent[a] * _FACTORS[0] + mixed(frequent[b])) | np.uint64(1 << 62))
            rests.append(rest_frequent[a])
            strong.append(np.ones(len(a), bool))
    return np.concatenate(keys).astype(np.int64), np.concatenate(rests).astype(np.int32), np.concatenate(strong)


DOC = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("keys", pa.list_(pa.int64())), ("rests", pa.list_(pa.int32())), ("strong", pa.list_(pa.bool_())), ("sign", pa.list_(pa.int64()))])


def _documents(table: pa.Table, frequent: int, most_combined: int) -> pa.Table:
    """One block: a row for each document; those that may have links get shared shingles and index keys."""
    forget()
    blocks, buckets, datas, metas = (table.column(c).to_pylist() for c in ("block", "bucket", "data", "meta"))
    meta = next(m for m in metas if m is not None)
    count = len(meta) // 17
    known, ids, sizes = np.frombuffer(meta, np.uint8, count), np.frombuffer(meta, np.int64, count, count), np.frombuffer(meta, np.int64, count, 9 * count)
    tokens, at, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bucket, d in zip(buckets, datas, strict=True):
        if d is not None:
            n = len(d) // 10
            tokens.append(np.frombuffer(d, np.uint32, n).astype(np.uint64) | np.uint64(bucket << 32))
            at.append(np.frombuffer(d, np.uint16, n, 4 * n).astype(np.int64))
            df.append(np.frombuffer(d, np.uint32, n, 6 * n).astype(np.int64))
    tokens, at, df = np.concatenate(tokens), np.concatenate(at), np.concatenate(df)
    order = np.lexsort((tokens, df, at))
    tokens, at, df = tokens[order], at[order], df[order]
    edges = np.searchsorted(at, np.arange(count + 1))
    rows: list[list] = [[], [], [], [], []]
    for i in range(count):
        a, b, n = edges[i], edges[i + 1], int(sizes[i])
        if n and b - a >= needed(n):
            for column, x in zip(rows, (np.sort(tokens[a:b]).tobytes(), *_keys(tokens[a:b], df[a:b], n, frequent, most_combined), parity(tokens[a:b])), strict=True):
                column.append(x)
        else:
            for column in rows:
                column.append(None)
    first = blocks[0] << 16
    return pa.table([
        pa.array(np.arange(count) + (first & (1 << 63) - 1)), pa.array([int(x) if k else None for x, k in zip(ids, known, strict=True)], pa.int64()), pa.array(sizes.copy()),
        pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.list_(pa.bool_())), pa.array(rows[4], pa.list_(pa.int64()))], schema=DOC)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y, m, n, s, t = (b.column(i).to_pylist() for i in range(6))
        linked = []
        for size, other, own, its in zip(m, n, s, t, strict=True):
            both = len(np.intersect1d(np.frombuffer(own, np.uint64), np.frombuffer(its, np.uint64), assume_unique=True))
            linked.append(100 * both >= 80 * (size + other - both))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).filter(keep), pa.array(y, pa.int64()).filter(keep)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    sets = docs.where("tokens IS NOT NULL").select("doc", "n", "tokens")
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("m"), F.col("tokens").alias("s"))
    right = sets.select(F.col("doc").alias("b"), "n", F.col("tokens").alias("t"))
    size = F.least("m", "n") * 100 >= F.greatest("m", "n") * 80
    return pairs.join(left, "a").join(right, "b").where(size).select("a", "b", "m", "n", "s", "t").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, label (least node of its component) of all nodes with an edge; alternating large and small stars."""
    spark, step, before, made = edges.sparkSession, 0, None, []
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        made.append(path := f"{folder}/stars-{step}")
        edges = stored(small, path)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        remove(spark, *made[:-1])
        made = made[-1:]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, step = now, step + 1


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, most_combined: int = MOST_COMBINED, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id of the rows it is linked to, directly or not)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "shingles")
    rows = id_text(docs, id_col, text_col).mapInArrow(lambda batches: _postings(batches, block_shingles), "bucket int, block long, data binary, meta binary")
    shared = rows.groupBy("bucket").applyInArrow(_shared, "block long, bucket int, data binary, meta binary")
    own = shared.groupBy("block").applyInArrow(lambda table: _documents(table, frequent, most_combined), "doc long, doc_id long, n long, tokens binary, keys array<long>, rests array<int>, strong array<boolean>, sign array<long>")
    own = stored(own, f"{folder}/docs")
    free_shuffles(spark)

    # equal sets are one entry: all their shingles are shared, so equal shared shingles of the full number tell them
    same = own.where("octet_length(tokens) = 8 * n").groupBy(F.sha2("tokens", 256).alias("set")).agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").select("set", "first")
    copies = own.where("octet_length(tokens) = 8 * n").select("doc", F.sha2("tokens", 256).alias("set")).join(same, "set").where("doc <> first")
    copies = stored(copies.select(F.col("first").alias("a"), F.col("doc").alias("b")), f"{folder}/copies")
    entries = own.where("keys IS NOT NULL").join(copies.select(F.col("b").alias("doc")), "doc", "left_anti").select("doc", F.col("n").cast("int").alias("n"), F.explode(F.arrays_zip("keys", "rests", "strong")).alias("e"))
    entries = entries.select(F.col("e.keys").alias("key"), "doc", "n", F.col("e.rests").alias("s"), F.col("e.strong").alias("strong"))
    # keys of one document, or of weak entries alone, are of no use
    used = entries.groupBy("key").agg(F.count("*").alias("c"), F.max("strong").alias("s")).where("c > 1 AND s").select("key")
    held = stored(entries.join(used, "key").withColumn("label", F.col("doc")), f"{folder}/held-0")
    free_shuffles(spark)
    # the rest from the first common key on is an upper bound of the overlap, the sizes tell how much of it a link needs
    may_link = 180 * F.least("s", "s_x") >= 80 * (F.col("n") + F.col("nx"))
    links, made = copies, [f"{folder}/copies"]
    for r in range(ROUNDS + 1):
        # of each key that holds more than one class: the largest class, and one document of it as the leader
        sizes = held.groupBy("key", "label").agg(F.count("*").alias("c"), F.max("strong").alias("s"), F.min_by(F.struct("doc", "n", "s"), F.struct(~F.col("strong"), (F.col("n") - F.col("s")) * int(not r), F.xxhash64("doc", F.lit(r)), "doc")).alias("leader"))
        sizes = sizes.groupBy("key").agg(F.max_by(F.struct("label", "leader"), F.struct("s", "c", "label")).alias("m"), F.count("*").alias("c")).where("c > 1").select("key", F.col("m.label").alias("most"), F.col("m.leader.doc").alias("x"), F.col("m.leader.n").alias("nx"), F.col("m.leader.s").alias("s_x"))
        outside = held.join(sizes, "key").where("label <> most")
        if r < ROUNDS:
            pairs = outside.where(may_link).select("x", F.col("doc").alias("y"))
        else:  # all that is left: what is outside meets all of other classes
            signs = own.where("keys IS NOT NULL").select("doc", "sign", (F.col("n") - F.octet_length("tokens") / 8).cast("int").alias("lone"))
            signed = held.join(signs, "doc")
            outside = outside.join(signs, "doc").select("key", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("s").alias("s_x"), F.col("label").alias("lx"), F.col("strong").alias("sx"), "most", F.col("sign").alias("sign_x"), F.col("lone").alias("lone_x"))
            # shingles of one document alone differ anyway
            apart = sum((F.bit_count(F.col("sign")[i].bitwiseXOR(F.col("sign_x")[i])) for i in range(SIGN_BITS // 64)), F.col("lone") + F.col("lone_x"))
            pairs = outside.join(signed, "key").where(may_link).where("label <> lx AND (strong OR sx) AND (label = most OR x < doc)").where(9 * apart <= F.col("n") + F.col("nx")).select("x", F.col("doc").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = stored(verified(pairs, own), f"{folder}/links-{r}")
        links = links.unionByName(found)
        label = components(links, f"{folder}/stars-{r}")
        made += [f"{folder}/held-{r}", f"{folder}/links-{r}", f"{folder}/stars-{r}"]
        if r < ROUNDS:
            held = held.drop("label").join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
            open_keys = held.groupBy("key").agg((F.min("label") < F.max("label")).alias("more")).where("more").select("key")
            held = stored(held.join(open_keys, "key").select("key", "doc", "n", "s", "strong", "label"), f"{folder}/held-{r + 1}")
        free_shuffles(spark)

    ids = own.select("doc", "doc_id", "n").join(label, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc"))
    least = ids.where("node IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = ids.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    out = stored(out, f"{folder}/out")
    remove(spark, f"{folder}/docs", *made)
    free_shuffles(spark)
    return out
