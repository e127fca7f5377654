"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score, then by position: a heap for a long part, a
row of ranks for each of many short ones, which are merged side by side. As no
piece of such a vocabulary has a space mark after another character, a text splits before each run of space
marks into segments that never merge with each other; segments that repeat are encoded once per worker. Every
segment that a worker meets for the first time is also encoded by the sentencepiece library, a batch at a time,
and a difference raises an error.

Defined results: null and empty texts have the ids <s> </s> alone and decode to "". Repeated rows and equal or
null ids each keep a row of their own. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, remembered, rows_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries and characters up to which a worker remembers segments; past it the memory starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48
#: Parts that are merged side by side, and segments that the library gets in one text.
AT_ONCE, TOGETHER = 32_768, 256
NO_PAIR, NO_ID = 1 << 60, 0xFFFFFFFF


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A vocabulary file with its encoder and decoder."""

    def __init__(self, path: str, verify: bool = True):
        pieces, scores, kinds = [], [], []
        self.dummy_prefix, strip, charsmap, unk_surface = True, True, b"", " ⁇ "
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                if own.get(3, 1) != 2:
                    raise ValueError("the vocabulary is not of the merge type")
                unk_surface = own[44].decode() if 44 in own else unk_surface
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.dummy_prefix, strip = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if charsmap or strip or not self.dummy_prefix or USER in kinds or UNUSED in kinds:
            raise NotImplementedError("normalising vocabularies and user-defined or unused pieces are not supported")
        self.score = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k == NORMAL}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.unk = kinds.index(UNKNOWN)
        self.bos, self.eos = pieces.index("<s>"), pieces.index("</s>")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise NotImplementedError("a piece has a space mark inside")
        joined = {c for p in self.score if len(p) > 1 for c in p}
        own_class = "".join(map(re.escape, sorted(joined - {MARK})))
        #: Characters that no longer piece holds stand alone; the rest go together with the marks before them.
        self.parts = re.compile(f"{MARK}*[{own_class}]+|{MARK}+|.", re.S)
        surfaces = [p if k == NORMAL else "" if k == CONTROL else unk_surface for p, k in zip(pieces, kinds, strict=True)]
        for b, i in self.byte_ids.items():
            surfaces[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.surface = surfaces
        self.head, self.tail = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        self._pairs()
        self.seen: dict[str, bytes] = {}
        self._tables()
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def _pairs(self) -> None:
        """Which two symbols make a piece: left << 20 | right -> rank of the score << 20 | symbol made."""
        symbols = {x: i for i, x in enumerate(dict.fromkeys([*self.score, *(c for p in self.score for c in p)]))}
        rank = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.symbol_of, self.no_symbol = symbols, (1 << 20) - 1
        self.pair = {
            symbols[p[:i]] << 20 | symbols[p[i:]]: rank[s] << 20 | symbols[p]
            for p, s in self.score.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols
        }
        self.ids_of = {symbols[p]: i for p, i in self.id_of.items()}

    def _agenda(self, part: str) -> bytes:
        n, pair, low = len(part), self.pair.get, self.no_symbol
        symbols = [self.symbol_of.get(c, low) for c in part]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [v >> 20 << 32 | i for i in range(n - 1) if (v := pair(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or symbols[left] < 0 or (v := pair(symbols[left] << 20 | symbols[right])) is None or v >> 20 != entry >> 32:
                continue
            symbols[left], symbols[right] = (made := v & low), -1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (v := pair(made << 20 | symbols[following])) is not None:
                    heapq.heappush(agenda, v >> 20 << 32 | left)
            if (previous := before[left]) >= 0 and (v := pair(symbols[previous] << 20 | made)) is not None:
                heapq.heappush(agenda, v >> 20 << 32 | previous)
        ids: list[int] = []
        for at, symbol in enumerate(symbols):
            if symbol >= 0:
                if (i := self.ids_of.get(symbol)) is not None:
                    ids.append(i)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in part[at].encode()]
                else:
                    ids.append(self.unk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _agendas(self, parts: list[str]) -> list[bytes]:
        """_agenda() of many parts, side by side by length: a row of an array is a part's agenda, the ranks of its adjacent
        pairs; in each step every part merges its pair of the best score, the first one on ties."""
        out: list[bytes | None] = [None] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for s in range(0, len(rows), AT_ONCE):
                some = rows[s : s + AT_ONCE]
                for i, ids in zip(some.tolist(), self._side_by_side([parts[i] for i in some.tolist()], high), strict=True):
                    out[i] = ids
        return [self._agenda(x) if ids is None else ids for x, ids in zip(parts, out, strict=True)]

    def _side_by_side(self, parts: list[str], width: int) -> list[bytes | None]:
        """None for parts with a character that is no symbol."""
        points = np.frombuffer("".join([x.ljust(width, "\0") for x in parts]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(parts), width)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        inside = np.arange(width) < lengths[:, None]
        symbols = np.where(inside & (self.points[at] == points), self.point_symbols[at], -1)
        odd = (inside & (symbols < 0)).any(1)
        found: list[bytes | None] = [None] * len(parts)
        rows = np.flatnonzero(~odd)
        symbols, left = symbols[rows], lengths[rows]
        value = self._value(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width)
        while len(rows):
            best = (value >> 20).argmin(1)
            n = np.arange(len(rows))
            own = value[n, best]
            done = own == NO_PAIR
            if done.any():
                ids = self.id_of_symbol[symbols[done]].astype("<u4")
                bad = ((ids == NO_ID) & (columns < left[done][:, None])).any(1)  # a symbol that is no piece is spelled in bytes
                for i, k, x, odd_one in zip(rows[done].tolist(), left[done].tolist(), ids, bad.tolist(), strict=True):
                    if not odd_one:
                        found[i] = x[:k].tobytes()
                go = ~done
                rows, symbols, value, left, best, own = rows[go], symbols[go], value[go], left[go], best[go], own[go]
                if not len(rows):
                    break
                n = np.arange(len(rows))
            symbols[n, best] = own & self.no_symbol
            # what stands after the merged pair moves one place to the front
            move = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, move, 1)
            left = left - 1
            symbols[n, left] = -1
            value = np.take_along_axis(value, np.minimum(move[:, :-1], width - 2), 1)
            value[n, np.minimum(left - 1, width - 2)] = NO_PAIR
            for place in (best - 1, best):
                inner = np.flatnonzero((place >= 0) & (place < width - 1))
                k = place[inner]
                value[inner, k] = self._value(symbols[inner, k], symbols[inner, k + 1])
        return found

    def _value(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the score << 20 | symbol made of two symbols, NO_PAIR where they make none."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        out = np.where(self.table_keys[slot] == key, self.table_values[slot], NO_PAIR)
        open_ = (self.table_keys[slot] != key) & (self.table_keys[slot] >= 0) & (a >= 0) & (b >= 0)
        while open_.any():  # the next slots, while they hold other keys
            slot = (slot + open_) & (len(self.table_keys) - 1)
            own = self.table_keys[slot]
            hit = open_ & (own == key)
            out[hit] = self.table_values[slot[hit]]
            open_ &= (own != key) & (own >= 0)
        return np.where((a >= 0) & (b >= 0), out, NO_PAIR)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _tables(self) -> None:
        """Symbols of characters, pieces of symbols, and the pairs in a hash table of a quarter's load."""
        chars = sorted((ord(c), i) for c, i in self.symbol_of.items() if len(c) == 1)
        self.points, self.point_symbols = (np.array(x) for x in zip(*chars, strict=True))
        self.id_of_symbol = np.full(len(self.symbol_of) + 1, NO_ID, np.int64)
        for symbol, i in self.ids_of.items():
            self.id_of_symbol[symbol] = i
        self.table_bits = max(4, (4 * len(self.pair)).bit_length())
        self.table_keys, self.table_values = np.full(1 << self.table_bits, -1, np.int64), np.zeros(1 << self.table_bits, np.int64)
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.table_keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.table_bits) - 1)
            self.table_keys[slot], self.table_values[slot] = key, self.pair[key]

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments: one or more spaces, then no space. All are held against the library's, a batch at a time."""
        split = [self.parts.findall(x.replace(" ", MARK)) for x in segments]
        parts = list({p for x in split for p in x})
        ids_of = dict(zip(parts, self._agendas(parts), strict=True))
        out = {x: b"".join([ids_of[p] for p in own]) for x, own in zip(segments, split, strict=True)}
        if self.library:
            known = [x for x in segments if len(x) > 1]  # a lone space would reach the library as an empty text
            # most segments stand side by side in a text as they do alone, so many are held against the library at once,
            # and one by one only where that differs
            for s in range(0, len(known), TOGETHER):
                some = known[s : s + TOGETHER]
                if b"".join([out[x] for x in some]) != array("I", self.library.encode("".join(some)[1:])).tobytes():
                    for x in some:
                        if out[x] != array("I", self.library.encode(x[1:])).tobytes():
                            raise RuntimeError(f"the ids of {x[:80]!r} differ from the library's")
        return out

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids with begin and end, as little-endian 32-bit integers; what is new is checked against the library."""
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        seen = self.seen
        split, odd = [], {}
        for i, text in enumerate(texts):
            if MARK in text:
                text = text.replace(MARK, " ")
            words = text.split(" ") if text else []
            if "" in words:  # runs of spaces belong to the segment that they begin
                odd[i] = re.findall(" +[^ ]*", " " + text)
                words = []
            split.append(words)
        new = set(chain.from_iterable(split)).difference(seen)
        rest = {x for own in odd.values() for x in own}
        found = self._learn([*(" " + w for w in new), *sorted(x for x in rest if x[1:] not in new)])
        long = {w: found[" " + w] for w in new if len(w) > REMEMBERED_CHARS}
        seen.update((w, found[" " + w]) for w in new if w not in long)
        out = []
        for i, words in enumerate(split):
            if i in odd:
                own = [found[x] for x in odd[i]]
            elif long and not long.keys().isdisjoint(words):
                own = [long[w] if w in long else seen[w] for w in words]
            else:
                own = map(seen.__getitem__, words)
            out.append(self.head + b"".join(own) + self.tail)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text in UTF-8. Bytes that are no character become U+FFFD one by one; the first space mark goes."""
        out = "".join(map(self.surface.__getitem__, ids))
        if out[:1] == MARK:
            out = out[1:]
        out = out.replace(MARK, " ")
        try:
            return out.encode()
        except UnicodeEncodeError:
            raw = out.encode("utf-8", "surrogateescape")
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> bytes:
    parts, at = [], 0
    while at < len(raw):
        try:
            parts.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            parts += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(parts).encode()


def piece_model(path: str) -> PieceModel:
    return remembered(("pieces", path), lambda: PieceModel(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (binary, little-endian 32 bits), with_text adds decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for ids, texts in rows_of(batches):
            encoded = model.encode_batch(texts)
            decoded = [model.decode(array("I", e)) for e in encoded]
            out = {
                "id": pa.array(ids, pa.int64()),
                "n_tokens": pa.array([len(e) // 4 for e in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            }
            if with_ids:
                out["ids"] = pa.array(encoded, pa.binary())
            if with_text:
                out["decoded"] = pa.array([d.decode() for d in decoded], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
