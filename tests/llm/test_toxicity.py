import random

import numpy as np
import pytest

from veilgraph.llm import toxicity

INSULTS = ["blorgface", "snigwit", "dumbleton", "grumhead"]


def corpus(n, seed):
    """Invented sentences; every third text holds insults, some of them gapped or with characters put in."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ka", "lo", "mi", "tur", "ben", "sol", "dra"]) for _ in range(r.randrange(1, 5))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randrange(20, 200))]
        if i % 3 == 0:
            for _ in range(max(2, len(own) // 40)):
                own[r.randrange(len(own))] = r.choice(INSULTS)
        texts.append(". ".join(" ".join(own[k : k + 9]) for k in range(0, len(own), 9)))
        labels.append(int(i % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*corpus(400, 1))


def by_hand(model, text):
    """The score of one text, word by word."""
    tokens = [*text.lower().split(), *toxicity.spelled(text.lower())]
    own = [u for t in tokens for u in toxicity.units(t)]
    margins = [float(model.margins([u])[0]) for u in own]
    return float(model.score([sum(min(1, max(0, m)) for m in margins)], [len(tokens)])[0])


def test_kernel_against_all_subsequences():
    def brute(a, b):
        from itertools import combinations

        total = 0.0
        for i in combinations(range(len(a)), toxicity.P):
            for j in combinations(range(len(b)), toxicity.P):
                if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                    total += float(toxicity.DECAY) ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    r = random.Random(3)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(4, 9))) for _ in range(2))
        got = toxicity.kernel(toxicity.codes([a], len(a), -1), toxicity.codes([b], len(b), -2))[0]
        assert got == pytest.approx(brute(a, b), rel=1e-3, abs=1e-7)


def test_held_out_texts(model):
    texts, labels = corpus(150, 2)
    scores = np.array([by_hand(model, t) for t in texts])
    y = np.array(labels)
    assert (scores[y == 1] >= 0.7).mean() >= 0.9 and (scores[y == 0] >= 0.7).mean() <= 0.02


@pytest.mark.parametrize("word", ["blorgface", "BLORGFACE!", "blorrgface", "blo.rg.face", "bl*orgface", "blxorgface", "b l o r g f a c e", "grumheads"])
def test_gapped_and_inserted(model, word):
    """Inserted characters and gaps leave an insult above the margin."""
    own = [u for t in [*word.lower().split(), *toxicity.spelled(word.lower())] for u in toxicity.units(t)]
    assert model.margins(own).max() > 0


def test_score_of_a_table(spark, docs_of, model):
    texts, _ = corpus(12, 5)
    some = [*texts, None, "", " \n", "blorgface snigwit you grumhead " * 3, "b-l-o-r-g-f-a-c-e and d u m b l e t o n", "ka lo mi " * 100_000 + "blorgface", texts[0]]
    docs = docs_of(some, [*range(len(some) - 1), 0])
    out = toxicity.score(docs, model, out_col="margin")
    assert out.columns == [*docs.columns, "margin"]
    rows = out.repartition(3).collect()
    want = sorted(round(by_hand(model, t or ""), 9) for t in some)
    assert sorted(round(r.margin, 9) for r in rows) == pytest.approx(want)
    assert {r.margin for r in rows if not (r.text or "").strip()} == {by_hand(model, "")}
    assert all(r.margin < 0.7 for r in rows if (r.text or "").startswith("ka lo mi")) and all(r.margin >= 0.7 for r in rows if (r.text or "").startswith("blorgface snigwit"))
    assert toxicity.score(docs_of([]), model).count() == 0


def test_training_on_a_table(spark, docs_of):
    texts, labels = corpus(120, 1)
    docs = docs_of([*texts, None, "x"], [*range(len(texts)), 500, 501])
    marks = spark.createDataFrame([*enumerate(labels), (500, 1), (501, None), (None, 1)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs.repartition(k), marks.repartition(k)) for k in (1, 5))
    assert a.landmarks == b.landmarks and np.array_equal(a.weights, b.weights) and np.array_equal(a.curve, b.curve)
    assert toxicity.train(docs, marks.where("toxic = 0")) is None and toxicity.train(docs.limit(0), marks) is None
    assert {r.toxicity for r in toxicity.score(docs.drop("toxicity"), None).collect()} == {0.0}
