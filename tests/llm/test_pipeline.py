import random
import zlib

import public_tokenizers
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline
from sentencepiece import SentencePieceProcessor
from veilgraph.llm import decontamination, pseudonyms
from veilgraph.llm.queries import DEMO_KEY

from .test_row_operators import distance_within

INSULTS = ("blorgface", "snigwit", "grumhead")


def word(r, n=3):
    return "".join(r.choice(["ka", "lo", "mi", "tur", "ben", "sol", "dra", "wex"]) for _ in range(r.randrange(1, n + 1)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, docs_of, tmp_path_factory):
    """A folder of tables with toxic texts, copies, benchmark passages, personal data, repeated ids, null, empty and long texts."""
    r = random.Random(31)
    items = [(k, prose(r, 20)) for k in range(6)] + [(50, None), (51, "")]
    rows, labels = [], []

    def add(text, kind, doc_id=None):
        rows.append((len(rows) if doc_id is None else doc_id, text, kind))

    for k in range(300):
        toxic = k % 3 == 0
        words = prose(r, r.randrange(25, 120)).split()
        for _ in range(max(2, len(words) // 30) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(INSULTS)
        add(" ".join(words), "toxic" if toxic else "clean")
        labels.append((rows[-1][0], int(toxic)))
    base = prose(r, 200).split()
    for k in range(6):
        own = list(base)
        own[k * 3] = "changed"
        add(" ".join(own), "copy")
    exact = prose(r, 40)
    for _ in range(5):
        add(exact, "exact")
    for _, item in items[:4]:
        add(f"{prose(r, 10)} {item[:30]}x{item[31:]} {prose(r, 10)}", "leak")
    add("Mail bob.42@mail8.example.com or +1 (386) 555-3733 on 2020-02-29 " + prose(r, 12), "private")
    for text in (None, "", " \n"):
        add(text, "none")
    add(prose(r, 60_000), "long")
    for _ in range(3):  # one id, texts of its own
        add(prose(r, 30), "same id", 7_000)
    add(rows[-1][1], "same row", 7_000)
    path = tmp_path_factory.mktemp("tables")
    docs_of([t for _, t, _ in rows], [i for i, _, _ in rows]).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_copies(rows):
    """Brute force over (id, text): of each group linked by Jaccard similarity the first of the least id."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        best.setdefault(root(i), []).append((k is None, k or 0))
    return sorted(min(x) for x in best.values())


def pairs(df):
    return [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kind = {}
    for i, t, k in rows:
        kind[i, t] = k
    kept = corpus_pipeline.drop_toxic(spark, docs, path)
    assert kept.columns == docs.columns
    after = pairs(kept)
    gone = sorted({(i, t) for i, t, _ in rows} - set(after), key=str)
    held_out = [(i, t) for i, t, k in rows if k == "toxic" and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(kind[x] == "toxic" for x in gone) and sum(x in gone for x in held_out) >= 0.9 * len(held_out)
    kept = corpus_pipeline.drop_near_copies(spark, kept, path)
    assert kept.columns == docs.columns
    want = without_copies(after)
    after = pairs(kept)
    assert sorted((i is None, i or 0) for i, _ in after) == want
    assert len({t for i, t in after if i == 7_000}) == 3 and sum(kind[x] == "exact" for x in after) == 1 and sum(kind[x] == "copy" for x in after) == 1
    kept = corpus_pipeline.drop_benchmark(spark, kept, path)
    assert kept.columns == docs.columns
    leaks = {x for x in after if any(t and distance_within(decontamination.normal(t), decontamination.normal((x[1] or "")[:5000])) <= int(0.06 * len(t)) for _, t in items)}
    assert {kind[x] for x in leaks} == {"leak"} and sorted(pairs(kept), key=str) == sorted((x for x in after if x not in leaks), key=str)
    after = pairs(kept)
    kept = corpus_pipeline.replace_personal_data(spark, kept, path)
    own = pseudonyms.Pseudonyms(DEMO_KEY)
    want = [(i, t if t is None else own.text(t)[0]) for i, t in after]
    assert kept.columns == docs.columns and sorted(pairs(kept), key=str) == sorted(want, key=str) and set(want) != set(after)
    assert all(x.n_chars == len(x.text) for x in kept.where("text IS NOT NULL").select("text", "n_chars").collect())
    out = corpus_pipeline.tokenise(spark, kept, path)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((x.doc_id, x.n_tokens) for x in out.collect()) == sorted((i, len(library.encode(t or "")) + 2) for i, t in want)


def test_empty_tables_and_null_ids(spark, corpus, docs_of):
    path = corpus[0]
    empty = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
    some = docs_of(["a b c d e f g"] * 3 + ["x y z"], [None, 5, 4, None])
    assert sorted(pairs(corpus_pipeline.drop_near_copies(spark, some, path)), key=str) == [(4, "a b c d e f g"), (None, "x y z")]


def test_run_is_the_stages(spark, corpus):
    path, rows, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < len(rows)
