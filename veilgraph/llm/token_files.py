"""Token files: one concatenated id array and Elias-Fano coded document boundaries.

A file holds a contiguous range of documents in ascending id order:

    ids (2 or 4 bytes each, little-endian) | boundaries | document ids | JSON head | head length (u32) | b"VGTK"

Boundaries and document ids are monotone sequences coded after Elias and Fano: the low bits of each value stand
packed, the high bits in unary in a bit vector; one 32-bit count a block of 512 bits, stored with them, answers
select(i) and range(i, j), so offsets are found without a table of 64-bit offsets. Executors write the files to the shared folder under
names of their own; only files that a finished task reports belong to the set, so repeated tasks do no harm.

Defined results: null and empty texts hold the end id alone. Strings of added tokens in a text get those tokens' ids,
as the library does by default. Null document ids come first, rows of one id in order of a hash of their texts. An empty table gives no file. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, parts_of, remembered, shared_dir

BLOCK = 512
#: Chunks that a worker remembers, and their bytes; past either the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64_000_000
#: Bytes of text that are encoded at once, unless one text has more.
BATCH_BYTES = 8_000_000
#: Chunks that the library gets in one call.
AT_ONCE = 16_384
SEPARATOR = "\0"
MAGIC = b"VGTK"


class EliasFano:
    """An ascending sequence of integers >= 0 in about 2 + log2(largest / count) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray | None = None):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        if before is None:
            counts = np.bitwise_count(np.pad(high, (0, -len(high) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1)
            before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        self.before = before

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if n else np.zeros((0, 0))
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.before), len(self.low), len(self.high)) + self.before.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, blocks, a, b = struct.unpack_from("<QBQQQ", data)
        at = 33 + 4 * blocks
        body = np.frombuffer(data, np.uint8, a + b, at)
        return cls(n, low_bits, body[:a], body[a:], np.frombuffer(data, "<u4", blocks, 33))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, shift = divmod(i * self.low_bits, 8)
        return int.from_bytes(self.low[first : first + (shift + self.low_bits + 7) // 8].tobytes(), "little") >> shift & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, "right")) - 1
        size = BLOCK // 8
        ones = np.flatnonzero(np.unpackbits(self.high[block * size : (block + 1) * size], bitorder="little"))
        return (block * BLOCK + int(ones[i - int(self.before[block])]) - i) << self.low_bits | self._low(i)

    def range(self, i: int, j: int) -> np.ndarray:
        """The values i to j - 1, from the blocks that hold them alone."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.uint64)
        first, last = (int(np.searchsorted(self.before, k, "right")) - 1 for k in (i, j - 1))
        size = BLOCK // 8
        ones = np.flatnonzero(np.unpackbits(self.high[first * size : (last + 1) * size], bitorder="little"))[i - int(self.before[first]) :][: j - i]
        high = (ones + (first * BLOCK - i)) - np.arange(j - i)
        at, skip = divmod(i * self.low_bits, 8)
        bits = np.unpackbits(self.low[at : (j * self.low_bits + 7) // 8], bitorder="little")[skip : skip + (j - i) * self.low_bits].reshape(j - i, self.low_bits).astype(np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) + (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        return self.range(0, self.n)


def _files(uri: str):
    """A file system that driver and executors reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes one file; ids go out as they come, only lengths and document ids are kept."""

    def __init__(self, folder: str, id_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.tok"
        self.fs, path = _files(self.path)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.id_bytes = self.fs.open_output_stream(path), id_bytes
        self.lengths, self.doc_ids = [], []

    def append(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Some documents: their ids one after the other, and how many each has."""
        self.out.write(ids.tobytes())
        self.lengths.append(lengths)
        self.doc_ids += doc_ids

    def close(self) -> tuple[str, int, int]:
        known = np.array([x for x in self.doc_ids if x is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.lengths]))]).astype(np.uint64)
        parts = [EliasFano.build(ends).to_bytes(), EliasFano.build((known - base).astype(np.uint64)).to_bytes()]
        head = json.dumps({"id_bytes": self.id_bytes, "ids": int(ends[-1]), "docs": len(self.doc_ids), "nulls": len(self.doc_ids) - len(known), "first": base, "sizes": [len(x) for x in parts]}).encode()
        for x in (*parts, head, struct.pack("<I", len(head)), MAGIC):
            self.out.write(x)
        self.out.close()
        return self.path, len(self.doc_ids), int(ends[-1])


class TokenFile:
    """Reads one file: any document by its place, or all in order."""

    def __init__(self, uri: str):
        fs, path = _files(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 8, 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        (n,) = struct.unpack("<I", tail[:4])
        self.head = json.loads(self._read(size - 8 - n, n))
        a, b = self.head["sizes"]
        at = self.head["ids"] * self.head["id_bytes"]
        self.bounds = EliasFano.from_bytes(self._read(at, a))
        self.doc_ids = EliasFano.from_bytes(self._read(at + a, b))
        self.kind = np.dtype(f"<u{self.head['id_bytes']}")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def doc_id(self, i: int) -> int | None:
        i -= self.head["nulls"]
        return None if i < 0 else self.doc_ids.select(i) + self.head["first"]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self._read(a * self.kind.itemsize, (b - a) * self.kind.itemsize), self.kind)

    def documents(self, at_once: int = 4_000_000, some: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, offset, ids) in order. The boundaries of some documents at a time are selected, and about at_once
        ids are in memory, or one document."""
        nulls = self.head["nulls"]
        for s in range(0, self.head["docs"], some):
            e = min(s + some, self.head["docs"])
            docs = [None] * (min(e, nulls) - min(s, nulls)) + (self.doc_ids.range(max(s, nulls) - nulls, max(e, nulls) - nulls).astype(np.int64) + self.head["first"]).tolist()
            ends = self.bounds.range(s, e + 1).astype(np.int64)
            i = 0
            while i < len(docs):
                j = min(max(i + 1, int(np.searchsorted(ends, ends[i] + at_once, "right")) - 1), len(docs))
                data = np.frombuffer(self._read(int(ends[i]) * self.kind.itemsize, int(ends[j] - ends[i]) * self.kind.itemsize), self.kind)
                for k in range(i, j):
                    yield docs[k], int(ends[k]), data[ends[k] - ends[i] : ends[k + 1] - ends[i]]
                i = j


class ChunkEncoder:
    """The tokenizers library over whole texts, each repeating chunk once.

    Pre-tokenisation of byte-level BPE always ends before a single space between two characters that are no white
    space, around a single line end between two such, and between a letter and a mark; so texts split there, and chunks
    are encoded alone. The split, the distinct chunks, the memory of chunks and the ids of a batch are column operations.
    A text with other white space is split at single spaces alone. Texts with a string of an added token, or with the
    separator, go to the library whole.
    """

    #: Letters that every Unicode version calls letters, and marks of ASCII.
    LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"

    def __init__(self, path: str, id_bytes: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # a run of letters after an optional space is one pre-token: no need to look for others
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype(f"<u{id_bytes}")
        (self.line_end,) = self._alone(["\n"])[0].tolist()
        self._clear()

    def _clear(self) -> None:
        """The memory: chunks, and of each the place and number of its ids."""
        self.chunks = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _alone(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for i in range(0, len(chunks), AT_ONCE) for e in self.library.encode_batch_fast(chunks[i : i + AT_ONCE], add_special_tokens=False)]

    def _lines(self, library, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number in each chunk. Chunks without line ends go to the library many to a text with one chunk a
        line: fewer calls, and a line end is one id of its own."""
        n = len(chunks)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, n, 256), n], pa.int32()), chunks), "\n")
        found, ends = [np.zeros(0, self.kind)], []
        for s in range(0, len(texts), AT_ONCE // 256):  # what the library returns takes far more memory than the ids
            for e in library.encode_batch_fast(texts[s : s + AT_ONCE // 256].to_pylist(), add_special_tokens=False):
                found.append(np.array([*e.ids, self.line_end], self.kind))
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.line_end)
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def _remember(self, chunks: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.chunks = pa.concat_arrays([self.chunks, chunks])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def _learn(self, new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, f"^ ?{self.LETTER}+$")
        chunks = new.filter(plain)
        self._remember(chunks, *self._lines(self.words, chunks))
        rest = new.filter(pc.invert(plain))
        alone = pa.array(["\n" in c or not _clean(c) for c in rest.to_pylist()], pa.bool_())
        chunks = rest.filter(pc.invert(alone))
        self._remember(chunks, *self._lines(self.library, chunks))
        chunks = rest.filter(alone)
        found = self._alone(chunks.to_pylist())
        self._remember(chunks, np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int64))

    def _slots(self, chunks: pa.Array, all_of_them: bool) -> np.ndarray:
        """Places in the memory; -1 for chunks that can't be encoded alone, unless all of them can."""
        own = chunks.dictionary_encode()
        words = own.dictionary
        at = pc.index_in(words, value_set=self.chunks)
        new = words.filter(pc.is_null(at))
        if len(new):
            if not all_of_them:
                plain = pc.match_substring_regex(new, f"^( ?{self.LETTER}+|{self.MARK}+)$").to_numpy(zero_copy_only=False)
                plain[~plain] = [_clean(c) for c in new.filter(pa.array(~plain)).to_pylist()]
                new = new.filter(pa.array(plain))
            self._learn(new)
            at = pc.index_in(words, value_set=self.chunks)
        return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)[own.indices.to_numpy()]

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[slots] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number in each text. Texts are not null."""
        if len(self.chunks) >= REMEMBERED or self.chunks.nbytes + self.ids.nbytes >= REMEMBERED_BYTES:
            self._clear()
        whole = pc.match_substring(texts, SEPARATOR)
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        whole = whole.to_numpy(zero_copy_only=False)
        cut = texts
        for old, put in (("\n", "\0\n\0"), (" ", "\0 ")):
            cut = pc.replace_substring(cut, old, put)
        cut = pc.replace_substring_regex(cut, f"({self.LETTER})({self.MARK})", "\\1\0\\2")
        split = pc.split_pattern(cut, SEPARATOR)
        del cut
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        slots = self._slots(split.flatten(), False)
        del split
        inside = np.concatenate([[0], np.cumsum(slots < 0)])
        apart = (inside[bounds[1:]] > inside[bounds[:-1]]) | whole
        sizes = self.sizes[np.maximum(slots, 0)] * (slots >= 0) if len(slots) else slots
        upto = np.concatenate([[0], np.cumsum(sizes)])
        lengths = upto[bounds[1:]] - upto[bounds[:-1]]
        if not apart.any():
            return self._gather(slots), lengths
        own = self._apart(texts.filter(pa.array(apart)).to_pylist(), whole[apart].tolist())
        parts, at = [], 0
        for i, found in zip(np.flatnonzero(apart).tolist(), own, strict=True):
            parts += [self._gather(slots[at : bounds[i]]), found]
            at, lengths[i] = bounds[i + 1], len(found)
        return np.concatenate([*parts, self._gather(slots[at:])]), lengths

    def _apart(self, texts: list[str], whole: list[bool]) -> list[np.ndarray]:
        """Texts that the common split doesn't fit."""
        pieces = [re.split(r"(?<=\S)(?= \S)", t) if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        slots = self._slots(pa.array([c for x in pieces for c in x], pa.string()), True)
        ends = np.cumsum([len(x) for x in pieces])
        return [self._alone([t])[0] if w else self._gather(slots[e - len(x) : e]) for t, w, x, e in zip(texts, whole, pieces, ends.tolist(), strict=True)]


def _clean(chunk: str) -> bool:
    core = chunk[1:] if chunk[:1] == " " else chunk
    return chunk == "\n" or core != "" and not core[0].isspace() and not core[-1].isspace()


@dataclass(frozen=True)
class TokenSet:
    """The files of one output in ascending document order: (path, documents, ids, ids of all files before)."""

    folder: str
    files: tuple[tuple[str, int, int, int], ...]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenSet:
    """Encodes each text, appends end_id and writes the files. The list of files is all that comes to the driver."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("chunks", tokenizer_path, id_bytes), lambda: ChunkEncoder(tokenizer_path, id_bytes))
        out, first = None, None
        for batch in parts_of(batches, BATCH_BYTES):
            doc_ids = batch.column(0).to_pylist()
            if not out:
                out, first = TokenFileWriter(folder, id_bytes), (doc_ids[0], batch.column(2)[0].as_py())
            ids, lengths = encoder.encode(batch.column(1))
            out.append(doc_ids, lengths + 1, np.insert(ids, np.cumsum(lengths), end_id))
            pa.default_memory_pool().release_unused()
        if out:
            path, n, total = out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64()), "first": pa.array([first[0]], pa.int64()), "tie": pa.array([first[1]], pa.int64())})

    # ordered before the encoder runs; a hash of the text parts rows of one id, however many, and orders them
    ordered = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    rows = ordered.mapInArrow(run, "path string, docs long, ids long, first long, tie long").collect()
    files, start = [], 0
    for r in sorted(rows, key=lambda r: (r.first is not None, r.first or 0, r.tie)):
        files.append((r.path, r.docs, r.ids, start))
        start += r.ids
    return TokenSet(folder, tuple(files))


def read_tokens(spark: SparkSession, tokens: TokenSet) -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, offset, ids in TokenFile(path).documents():
                    rows.append((doc_id, base + offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f[0], f[3]) for f in tokens.files], "path string, base long")
    return files.repartition(max(1, len(tokens.files))).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
