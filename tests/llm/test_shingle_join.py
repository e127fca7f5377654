import random

import numpy as np

from veilgraph.llm import shingle_join


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(r, groups=12, sizes=(1, 2, 3, 9), words=60):
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    passage = [word() for _ in range(20)]
    texts = [None, "", " \n", "One two", "one TWO", "x"]
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(3, words))] + passage * r.randrange(2)
        for _ in range(r.choice(sizes)):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


def test_equals_brute_force(spark, docs_of):
    for seed, frequent, most, block in ((2, 2, 40, 500), (3, 2, 3, 500), (4, 16, 24, 1_000_000)):
        texts = corpus(random.Random(seed))
        got = shingle_join.classes(docs_of(texts), frequent=frequent, most_combined=most, block_shingles=block).collect()
        assert sorted(map(tuple, got)) == brute(texts), seed


def test_edges(spark, docs_of):
    assert shingle_join.classes(docs_of([])).count() == 0
    rows = shingle_join.classes(docs_of(["a b c d e f", "a b c d e f", "a b c d e f"], [7, 7, None])).collect()
    assert sorted(r.component_id for r in rows) == [7, 7, 7]


def test_parity_never_tells_more_than_the_difference():
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 1500, r.integers(1, 900))).astype(np.uint64) for _ in range(2))
        apart = int(np.bitwise_count((shingle_join.parity(a) ^ shingle_join.parity(b)).view(np.uint64)).sum())  # of signed numbers numpy counts the magnitude
        assert apart <= len(np.setxor1d(a, b)) and not (shingle_join.parity(a) ^ shingle_join.parity(a.copy())).any()


def test_group_on_the_threshold(spark, docs_of):
    """Copies of one text with some words changed each: links and non-links of close similarity, also after the leader rounds."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(110)]
    texts = []
    for _ in range(90):
        own = list(base)
        for _ in range(r.randrange(6)):
            own[r.randrange(len(own))] = f"x{r.randrange(12)}"
        texts.append(" ".join(own))
    assert sorted(map(tuple, shingle_join.classes(docs_of(texts)).collect())) == brute(texts)
