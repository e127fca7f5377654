"""Personal data: keyed, format-preserving pseudonyms.

Values are found by pattern and validated (Luhn, mod 97, calendar, numbering plans); each is mapped to a number below
the size of its format, permuted by a keyed Feistel network with cycle walking, and written back in the same format.
The permutation depends on key and format alone, so equal values get equal pseudonyms in all documents, and different
values different ones. Check digits are computed anew and numbers stay within their plan, so a pseudonym is valid like
its value; dates keep their order, mark and width. The key is the caller's: who has it can turn pseudonyms back.

Defined results: null texts stay null, texts without such values are unchanged to the letter. Repeated rows are
treated one by one. Columns that are to stay are named; others are not read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import forget, fresh

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed bijection on range(size)."""

    def __init__(self, key: bytes, label: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.width, self.mask = (self.half + 7) // 8, (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{label}:{size}:{i}".encode(), key=key, digest_size=32).digest() for i in range(ROUNDS)]

    def _round(self, i: int, x: int) -> int:
        need, out, at = self.width, b"", 0
        while len(out) < need:
            out += hashlib.blake2b(x.to_bytes(self.width, "big") + bytes([at]), key=self.keys[i], digest_size=min(64, need)).digest()
            at += 1
        return int.from_bytes(out[:need], "big") & self.mask

    def _once(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in range(ROUNDS):
            a, b = b, a ^ self._round(i, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for i in reversed(range(ROUNDS)):
            a, b = b ^ self._round(i, a), a
        return a << self.half | b

    def forward(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def backward(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


def luhn(digits: str) -> int:
    """0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


#: Kinds in order of preference where two begin at one place.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d]|-\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?![\d]|-\d)"),
)
FOUND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: Found in every text that holds a value.
LIKELY = re.compile(r"@|\d[\d ()./-]{5}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}")
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def country_code(head: str) -> bool:
    """Whether the North American plan holds."""
    return head in ("", "1")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key, self.known, self.cache = key, {}, {}

    def _permute(self, label: str, size: int, x: int) -> int:
        if (p := self.known.get((label, size))) is None:
            p = self.known[label, size] = Permutation(self.key, label, size)
        return p.forward(x)

    def _mixed(self, label: str, digits: list[int], bases: list[int]) -> list[int]:
        """Permutes a number whose places have the bases."""
        size, x = 1, 0
        for d, b in zip(digits, bases, strict=True):
            size, x = size * b, x * b + d
        x, out = self._permute(label, size, x), []
        for b in reversed(bases):
            x, d = divmod(x, b)
            out.append(d)
        return out[::-1]

    def _letters(self, label: str, text: str) -> str:
        """Each letter or digit becomes one of its own kind."""
        kinds = [next((k for k in CLASSES if c in k), None) for c in text]
        own = iter(self._mixed(label, [k.index(c) for c, k in zip(text, kinds, strict=True) if k], [len(k) for k in kinds if k]))
        return "".join(k[next(own)] if k else c for c, k in zip(text, kinds, strict=True))

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        own = iter(digits)
        return "".join(next(own) if c.isdigit() else c for c in shape)

    def email(self, v: str) -> str | None:
        local, _, domain = v.partition("@")
        if not any(c.isalnum() for c in local):
            return None
        return f"{self._letters('email@' + domain.lower(), local)}@{domain}"

    def card(self, v: str) -> str | None:
        d = re.sub(r"\D", "", v)
        if luhn(d) or len(set(d)) == 1:
            return None
        body = "".join(map(str, self._mixed("card", [int(c) for c in d[:-1]], [10] * (len(d) - 1))))
        return self._fill(v, body + str(-luhn(body + "0") % 10))

    def ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        return None if max(parts) > 255 else ".".join(map(str, self._mixed("ip", parts, [256] * 4)))

    def ssn(self, v: str) -> str | None:
        a, b, c = int(v[:3]), int(v[4:6]), int(v[7:])
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        a, b, c = self._mixed("ssn", [a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999])
        return f"{a + 1 + (a >= 665):03}-{b + 1:02}-{c + 1:04}"

    def phone(self, v: str) -> str | None:
        d = re.sub(r"\D", "", v)
        country = re.match(r"\+(\d{1,3})(?=\D)", v)
        head = len(country[1]) if country else 2 * (v[0] == "+")
        own = d[head:]
        american = len(own) == 10 and country_code(d[:head]) and own[0] not in "01" and own[3] not in "01"
        if v[0] == "+":
            if not 8 <= len(d) <= 15:
                return None
        elif not american or not re.search(r"\D", v):
            return None  # without a country code only what the North American plan allows
        if american:
            lead = (0, 3)
            out = self._mixed("phone", [int(c) - 2 * (i in lead) for i, c in enumerate(own)], [8 if i in lead else 10 for i in range(10)])
            return self._fill(v, d[:head] + "".join(str(x + 2 * (i in lead)) for i, x in enumerate(out)))
        out = [int(c) for c in own]
        while True:  # numbers outside the plan stay outside
            out = self._mixed(f"phone{d[:head]}", out, [10] * len(own))
            if not (len(own) == 10 and country_code(d[:head]) and out[0] > 1 and out[3] > 1):
                return self._fill(v, d[:head] + "".join(map(str, out)))

    def iban(self, v: str) -> str | None:
        plain = v.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._letters("iban" + plain[:2], plain[4:])
        own = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body)
        return "".join(next(own) if c != " " else c for c in v)

    def date(self, v: str) -> str | None:
        a, b, c = map(int, re.split(r"\D", v))
        mark = re.search(r"\D", v)[0]
        pad = 1 if re.search(r"(?<!\d)\d(?!\d)", v) else 2  # as wide as they were written
        big = a > 31
        orders = [(a, b, c)] if big else [(c, b, a), (c, a, b)] if mark != "/" else [(c, a, b), (c, b, a)]
        for i, (y, m, d) in enumerate(orders):
            try:
                day = dt.date(y, m, d).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            n = dt.date.fromordinal(FIRST_DAY + self._permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY))
            if big:
                return f"{n.year}{mark}{n.month:02}{mark}{n.day:02}"
            month_first = (mark == "/") != bool(i)
            x, y = (n.month, n.day) if month_first else (n.day, n.month)
            return f"{x:0{pad}}{mark}{y:0{pad}}{mark}{n.year}"
        return None

    def value(self, kind: str, v: str) -> str | None:
        """The pseudonym, None where v is not valid."""
        if (kind, v) not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[kind, v] = getattr(self, kind)(v)
        return self.cache[kind, v]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of the values in the old text."""
        if not LIKELY.search(text):
            return text, []
        spans, out, done, at = [], [], 0, 0
        while m := FOUND.search(text, at):
            kind, at = m.lastgroup, m.end()
            new = self.value(kind, m[0])
            if new is None and kind in ("card", "phone"):  # shorter runs of its digits may be a number of their own
                for end in range(m.end() - 1, m.start() + 7, -1):
                    part = text[m.start() : end]
                    if part[-1].isdigit() and not text[end].isdigit():
                        kind = "card" if len(re.sub(r"\D", "", part)) >= 13 else "phone"
                        if (new := self.value(kind, part)) is not None:
                            at = end
                            break
                else:
                    at = re.compile(r"\d+|.", re.S).match(text, m.start()).end()
            elif new is None:
                at = re.compile(r"[A-Za-z0-9]+|.", re.S).match(text, m.start()).end()
            if new is not None:
                out += [text[done : m.start()], new]
                spans.append((kind, m.start(), at))
                done = at
        return "".join([*out, text[done:]]) if out else text, spans


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", keep: list[str] | None = None, spans: bool = True, spans_col: str = "pii_spans") -> DataFrame:
    """The columns in keep (all others by default), the text with pseudonyms and, if asked for, spans_col: array of (kind, start, end)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    own_text = fresh("text", keep)
    own_spans = fresh("spans", [*keep, own_text])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(own_text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = Pseudonyms(key)
        for b in batches:
            pairs = [(None, []) if t is None else own.text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            found = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for _, x in pairs], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([t for t, _ in pairs], pa.string()), *[found] * spans], names=[*b.schema.names, *[own_spans] * spans])

    schema = StructType([*rows.schema, *StructType.fromDDL(f"{own_spans} array<struct<kind:string,start:int,end:int>>")]) if spans else rows.schema
    out = rows.mapInArrow(run, schema)
    order = [F.col(f"`{own_text}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c == text_col or c in keep]
    return out.select(*order, *([F.col(f"`{own_spans}`").alias(spans_col)] if spans else []))
