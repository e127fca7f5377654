import hashlib
import random
import struct

import public_tokenizers
import sentencepiece

from veilgraph.llm.sentence_pieces import PieceModel, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " ", "  a  b ", "\n\n x\ty", "Erer ererou or to shre", "ciónrrción ñ", "▁x ▁", "漢字 🎉 \x00 end", "a" * 300, "<s> </s> <0x41> <unk>", " 　x", "é́" * 5]


def random_texts():
    r = random.Random(3)
    return ["".join(r.choice("ab  .\nthe ing▁éñ漢🎉<>0x") for _ in range(r.randrange(60))) for _ in range(400)]


def test_equals_the_library():
    own, sp = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = TEXTS + random_texts()
    for text, got in zip(texts, own.encode_batch(texts), strict=True):
        ids = list(struct.unpack(f"<{len(got) // 4}I", got))
        assert ids == sp.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids).decode() == sp.decode(ids), text


def test_both_agendas_agree():
    """Parts of all lengths, with characters that are no piece, by the heap and side by side."""
    own, r = PieceModel(PATH), random.Random(8)
    parts = list({"".join(r.choice("▁abcdeéñ漢🎉thein0.") for _ in range(r.randrange(1, 40))) for _ in range(3000)} | {"a" * n for n in range(1, 40)})
    assert own._agendas(parts) == [own._agenda(p) for p in parts]


def test_a_very_long_text_and_ties():
    own, sp = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["word and word " * 50_000 + "x" * 5_000, "aaaa aaaaa aaaaaa " * 10, "word and word " * 3]
    for text, got in zip(texts * 2, own.encode_batch(texts * 2), strict=True):
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == sp.encode(text, add_bos=True, add_eos=True)


def test_decodes_any_ids():
    own, sp = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(5)
    for _ in range(500):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randrange(8))]
        if 0 not in ids:
            assert own.decode(ids).decode() == sp.decode(ids), ids


def test_rows(spark, docs_of):
    docs = docs_of([None, "", "x y", "x y"], [3, 4, 5, 5])
    rows = sorted(encode_decode(docs, PATH, with_ids=True, with_text=True).collect())
    assert [(r.id, r.n_tokens, r.decoded) for r in rows] == [(3, 2, ""), (4, 2, ""), (5, 4, "x y"), (5, 4, "x y")]
    assert rows[0].ids_sha256 == hashlib.sha256(struct.pack("<2I", 1, 2)).hexdigest()
    assert encode_decode(docs.limit(0), PATH).count() == 0
