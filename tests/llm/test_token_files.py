import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from veilgraph.llm.token_files import ChunkEncoder, EliasFano, TokenFile, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(2)
    fixed = ["", " ", "a", "a  b\n\nc \n d\n", "\n", "x.\ny", "\tq\x85z \x1c w", "<|endoftext|> b", "x<|endoftext|>", "a <|endoftext|> <|endo, b", "word, words. word " + "y" * 60 + " z", "é ñ 漢字 🎉 it's 12 34\r\n", "a\0b c", "it 's x"]
    return fixed + ["".join(r.choice("ab .,'s\n\n  \t1é漢\x1c\xa0") for _ in range(r.randrange(50))) for _ in range(600)]


def test_chunks_equal_whole_texts():
    own, lib = ChunkEncoder(PATH, 2), library()
    for _ in range(2):
        ids, lengths = own.encode(pa.array(texts(), pa.string()))
        for text, got in zip(texts(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    assert 50256 in ids.tolist()
    ids, lengths = own.encode(pa.array([], pa.string()))
    assert not len(ids) and not len(lengths)


def test_a_very_long_text():
    text = "Lorem ipsum, dolor sit amet. " * 100_000 + "x" * 100_000
    ids, lengths = ChunkEncoder(PATH, 2).encode(pa.array(["a", text, ""], pa.string()))
    assert ids.tolist() == library().encode("a", add_special_tokens=False).ids + library().encode(text, add_special_tokens=False).ids and lengths[2] == 0


def test_elias_fano():
    r = random.Random(1)
    for values in ([], [0], [7], [0, 0, 0], sorted(r.randrange(10**12) for _ in range(3000)), list(range(2000)), sorted(r.randrange(50) for _ in range(1500))):
        own = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
        assert own.values().tolist() == values
        assert [own.select(i) for i in range(len(values))] == values
        for i in range(0, len(values), 7):
            assert own.range(i, min(len(values), i + 701)).tolist() == values[i : i + 701]


def test_round_trip(spark, docs_of):
    some = [None, *texts()[:40]]
    ids = [r * 3 % 31 if r else None for r in range(len(some))]
    tokens = write_tokens(docs_of(some, ids).repartition(3), PATH, end_id=2)
    lib, start, expected = library(), 0, []
    own = sorted(zip(ids, some, strict=True), key=lambda x: (x[0] is not None, x[0]))
    got = sorted(read_tokens(spark, tokens).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [i for i, _ in own]
    by_id: dict = {}
    for i, t in own:
        e = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        by_id.setdefault(i, []).append((len(e), zlib.crc32(e.tobytes())))
        expected.append(len(e))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in by_id[r.id]
        start += r.n_tokens
    assert start == sum(expected)
    first = TokenFile(tokens.files[0][0])
    assert [d for d, _, _ in first.documents(some=2)] == [first.doc_id(i) for i in range(first.head["docs"])]
    assert [(d, x.tolist()) for d, _, x in first.documents(at_once=5)] == [(first.doc_id(i), first.ids(i).tolist()) for i in range(first.head["docs"])]
    assert write_tokens(docs_of([]), PATH, end_id=2).files == () and read_tokens(spark, write_tokens(docs_of([]), PATH, end_id=2)).count() == 0


def test_one_id_for_all_rows(spark, docs_of):
    some = [f"text {k}" for k in range(400)]
    for ids in ([None] * 400, [5] * 400):
        tokens = write_tokens(docs_of(some, ids).repartition(4), PATH, end_id=2)
        rows = sorted(read_tokens(spark, tokens).collect(), key=lambda r: r.start)
        assert len(rows) == 400 and {r.id for r in rows} == {ids[0]} and [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
