"""Toxicity: a support vector machine over a gappy subsequence kernel of words, with Nyström landmarks.

The kernel of two words sums decay ** (spans) over their common subsequences of P characters, so an insult with
inserted or missing characters stays near its plain form. Words are lower-cased, marks inside them are dropped, runs
of single letters are joined, long words are cut into overlapping windows. The kernel against the landmarks, whitened
(Nyström), is the feature vector of a word.

Landmarks are words and stems that speak for toxic texts (likelihood ratio by text), all that are unlike each other,
and some common words. The machine is trained on the sentences of labelled texts, each by its highest word: sentences
of clean texts are negative, those of toxic texts that have a word above the margin (at first: a speaking word) are
positive; words and machine are chosen in turns. A text is scored by a logistic curve over the sum of its positive
margins and the share of that sum in its words, since one chance hit in a long text is no insult.

The machine is fitted in one task on a bounded sample: MAX_TRAINING texts of each label, chosen by a hash of the id, and
of those the first MAX_TRAINING_CHARS characters' worth of whole texts. Scoring reads whole texts in Arrow batches and
remembers the margins of words.

Defined results: null, empty and wordless texts get the score of no words at all. Repeated rows are scored one by
one. Labels that are null are left out of training; without texts of both labels all scores are 0. An empty table gives
an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, parts_of, remembered

P, DECAY = 4, np.float32(0.6)
WINDOW, STEP = 16, 8
#: Landmarks are all words and stems that speak for toxicity, words that carry the stems, and COMMON_LANDMARKS others, as
#: far as they are less alike than ALIKE.
#: The kernel counts for words that have NEAR of a landmark's characters, P at least, and is 0 for others.
COMMON_LANDMARKS, CARRIERS, ALIKE, NEAR = 4, 6, 0.9, 0.7
#: Weight of a speaking word's form with a character put in, against the word itself: such forms are trained on as well.
CHANGED = 0.2
#: Bounds of the sample that the machine is fitted on, by label.
MAX_TRAINING, MAX_TRAINING_CHARS = 2500, 20_000_000
#: Pairs of a word and a landmark that are compared at once, and words that are looked up at once.
PAIRS, WORDS_AT_ONCE = 250_000, 20_000
#: Lengths of the word beginnings that count as evidence beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Likelihood-ratio statistic from which a word is taken to speak for a label.
SURE = 16.0
REMEMBERED = 500_000
#: Bytes of text that are scored at once, unless one text has more.
BATCH_BYTES = 8_000_000
NOT_LETTERS = re.compile(r"[\W_]+")
#: Three or more single letters, with a space or mark between; and a quick test for such.
SPELLED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w(?!\w)){2,}")
MAY_BE_SPELLED = r"(^|[^\pL\pN])[\pL\pN_][ .*_-][\pL\pN_][ .*_-][\pL\pN_]($|[^\pL\pN])"
SENTENCE_END = re.compile(r"[.!?\n]+")


def units(token: str) -> list[str]:
    """What of a token is compared: its letters and digits, in windows where it is long."""
    word = token if token.isalnum() else NOT_LETTERS.sub("", token)
    if len(word) <= WINDOW:
        return [word] if len(word) >= P else []
    return [word[i : i + WINDOW] for i in range(0, len(word) - STEP, STEP)]


def spelled(text: str) -> list[str]:
    """Words spelled letter by letter."""
    return [NOT_LETTERS.sub("", x) for x in SPELLED.findall(text)]


def sentences(text: str) -> list[list[str]]:
    """Units of each sentence; spelled words are a sentence of their own."""
    low = text.lower()
    parts = [[u for t in x.split() for u in units(t)] for x in SENTENCE_END.split(low)]
    parts += [units(x) for x in spelled(low)]
    return [x for x in parts if x]


def codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), width)
    return np.where(out == 0, pad, out)


def _powers(n: int) -> np.ndarray:
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def kernel(a: np.ndarray, b: np.ndarray, at_once: int = 4_000) -> np.ndarray:
    """Of the words in row i of a and b, which are padded with different values."""
    out = np.empty(len(a), np.float32)
    left, right = _powers(a.shape[1]), _powers(b.shape[1])
    for s in range(0, len(a), at_once):
        match = (a[s : s + at_once, :, None] == b[s : s + at_once, None, :]).astype(np.float32) * DECAY**2
        n, p, q = match.shape
        k = np.ones_like(match)
        for _ in range(P - 1):
            x = (match * k).reshape(n * p, q) @ right.T
            x = x.reshape(n, p, q).swapaxes(1, 2).reshape(n * q, p) @ left.T
            x = x.reshape(n, q, p).swapaxes(1, 2)
            k = np.zeros_like(match)
            k[:, 1:, 1:] = x[:, :-1, :-1]
        out[s : s + at_once] = (match * k).sum((1, 2))
    return out


def overlap(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in common, with repeats, of each word of a with each of b."""
    letters = np.unique(codes(b, max(map(len, b)), 0))
    letters = letters[letters > 0]
    most = max(w.count(c) for w in b for c in w)

    def bags(words: list[str]) -> np.ndarray:
        c = codes(words, max(1, max(map(len, words))), 0)
        at = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
        row, col = np.nonzero(letters[at] == c)
        n = np.bincount(row * len(letters) + at[row, col], minlength=len(words) * len(letters)).reshape(len(words), -1)
        return np.hstack([n > k for k in range(most)]).astype(np.float32)

    return bags(a) @ bags(b).T


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark; pairs with too few characters in common are 0 and skipped."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    if len(words) > (most := max(1, PAIRS // len(landmarks))):
        for s in range(0, len(words), most):
            out[s : s + most] = similarities(words[s : s + most], landmarks)
        return out
    i, j = np.nonzero(overlap(words, landmarks) >= [max(P, NEAR * len(x)) for x in landmarks])
    if not len(i):
        return out
    b = codes(landmarks, max(map(len, landmarks)), -2)
    own = kernel(b, np.where(b == -2, -3, b))
    lengths, widths = np.array([len(w) for w in words]), np.array([len(w) for w in landmarks])
    # pairs of like lengths together, so that little is computed on padding
    for low, high in ((0, 7), (7, 10), (10, WINDOW)):
        inside = (lengths > low) & (lengths <= high)
        if not inside.any():
            continue
        rows = np.flatnonzero(inside)
        a = codes([words[r] for r in rows], high, -1)
        place = np.zeros(len(words), np.int64)
        place[rows] = np.arange(len(rows))
        for least, most in ((0, 6), (6, 9), (9, WINDOW)):
            pick = np.flatnonzero(inside[i] & (widths[j] > least) & (widths[j] <= most))
            if len(pick):
                out[i[pick], j[pick]] = kernel(a[place[i[pick]]], b[j[pick], :most])
        used = np.flatnonzero(out[rows].any(1))
        if len(used):
            own_a = kernel(a[used], np.where(a[used] == -1, -3, a[used]))
            out[rows[used]] /= np.sqrt(np.maximum(own_a[:, None] * own, 1e-20))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        return similarities(words, self.landmarks) @ self.weights + self.bias

    def score(self, total, n) -> np.ndarray:
        """From the sum of the positive margins and the number of words of each text."""
        return 1 / (1 + np.exp(-np.clip(_of_text(total, n) @ self.curve, -30, 30)))


def _of_text(total, n) -> np.ndarray:
    total, n = np.asarray(total, float), np.asarray(n, float)
    # bounded, so that texts whose label is wrong do not decide the curve
    return np.stack([np.log1p(np.minimum(total, 4)), np.clip(np.log((total + 0.2) / (n + 30)), -6.5, -3.5), np.ones(len(n))], 1)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 40) -> np.ndarray:
    """Weights and bias of the squared-hinge machine with equal weight of both labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    for side in (y > 0, y < 0):
        weight[side] *= c * len(y) / 4 / weight[side].sum()
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        own = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + own.T @ x[inside], own.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def _without_copies(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Near copies share their rare words and would make those look like evidence: one of each group stays."""
    seen: set = set()
    out = []
    for text, label in zip(texts, labels, strict=True):
        words = text.lower().split()
        grams = [" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))]
        least = {(label, salt, min(zlib.crc32(g, salt) for g in grams)) for salt in (1, 7, 1_000_003)}
        if least.isdisjoint(seen):
            out.append((text, label))
        seen |= least
    return [t for t, _ in out], [k for _, k in out]


def _unlike(pool: list[str], landmarks: list[str], most: int) -> list[str]:
    """Up to most words of the pool, the first ones first, each less alike than ALIKE to all landmarks."""
    landmarks = list(landmarks)
    near = similarities(pool, landmarks).max(1) if landmarks and pool else np.zeros(len(pool))
    for _ in range(most):
        free = np.flatnonzero(near <= ALIKE)
        if not len(free):
            break
        landmarks.append(pool[free[0]])
        near = np.maximum(near, similarities(pool, landmarks[-1:])[:, 0])
        near[free[0]] = 1
    return landmarks


def _with_insertions(words: list[str], times: np.ndarray, most: int = 200) -> tuple[list[str], np.ndarray]:
    """The words that occur most often, each with a foreign character put in at each place, and whose forms they are."""
    out, of = [], []
    for i in np.argsort(-times, kind="stable")[:most].tolist():
        if times[i] and len(words[i]) < WINDOW:
            out += [words[i][:k] + "\x01" + words[i][k:] for k in range(1, len(words[i]))]
            of += [i] * (len(words[i]) - 1)
    return out, np.array(of, int)


def _speaking(words: list[str], text_of: np.ndarray, word_of: np.ndarray, y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words and stems that speak for label 1 by the likelihood ratio of the texts that hold them, strongest first, and
    whether each word is or begins with one; after them, the words that carry each most often, CARRIERS in toxic texts and one
    in others. Of a word and its beginnings the strongest counts, the longest on a tie."""
    wide = np.array(words, f"U{WINDOW}")
    lengths = np.char.str_len(wide)
    names, stem_of, parts = [], [], []
    for k in (*STEMS, WINDOW):
        name, at = np.unique(wide.astype(f"U{k}"), return_inverse=True)
        at = np.where((lengths > k) | (k == WINDOW), at, -1)
        names.append(name.astype(f"U{WINDOW}"))
        stem_of.append(at)
        own = at[word_of]
        pairs = np.unique(text_of[own >= 0].astype(np.int64) * len(name) + own[own >= 0])
        parts.append((pairs // len(name), pairs % len(name)))
    first = np.concatenate([[0], np.cumsum([len(x) for x in names])])
    names = np.concatenate(names)
    text, stem = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + f for p, f in zip(parts, first, strict=False)])
    n1 = int(y.sum())
    q = np.bincount(stem[y[text] == 0], minlength=len(names))
    p = np.bincount(stem[y[text] == 1], minlength=len(names))
    both = p + q
    expected = np.maximum(both * (n1 / len(y)), 1e-9)
    g = p * np.log(np.maximum(p, 1e-9) / expected) + q * np.log(np.maximum(q, 1e-9) / np.maximum(both - expected, 1e-9))
    sure = np.flatnonzero((p >= 2) & (p > expected) & (g > SURE))
    size = np.char.str_len(names[sure])
    chosen: list[int] = []
    inside, begun = set(), set()  # names chosen, and all beginnings of them
    for i in sure[np.lexsort((names[sure], -size, -g[sure].round(6)))].tolist():
        name = str(names[i])
        starts = {name[:k] for k in range(1, len(name) + 1)}
        if name not in begun and starts.isdisjoint(inside):
            chosen.append(i)
            inside.add(name)
            begun |= starts
    carries, carried = np.zeros(len(words), bool), []
    times = [np.bincount(word_of[y[text_of] == k], minlength=len(words)) for k in (1, 0)]
    for i in chosen:
        level = int(np.searchsorted(first, i, "right")) - 1
        mine = np.flatnonzero(stem_of[level] + first[level] == i)
        mine = mine[stem_of[level][mine] >= 0]
        carries[mine] = True
        for own, most in zip(times, (CARRIERS, 1), strict=True):
            carried += mine[np.argsort(-own[mine], kind="stable")[:most]].tolist()
    return [str(names[i]) for i in chosen] + [words[i] for i in dict.fromkeys(carried)], carries


def fit(texts: list[str], labels: list[int], population: tuple[int, int] | None = None, rounds: int = 3) -> ToxicityModel | None:
    """population: how many texts of label 0 and 1 the sample stands for."""
    texts, labels = _without_copies(texts, labels)
    y = np.array(labels)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    at: dict[str, int] = {}
    flat, sentence_sizes, sentence_text = [], [], []
    for i, text in enumerate(texts):
        for x in sentences(text):
            flat.append(np.array([at.setdefault(u, len(at)) for u in x], np.int32))
            sentence_sizes.append(len(x))
            sentence_text.append(i)
    if not flat:
        return None
    word_of, sentence_text = np.concatenate(flat), np.array(sentence_text)
    starts = np.concatenate([[0], np.cumsum(sentence_sizes)[:-1]])
    text_of = np.repeat(sentence_text, sentence_sizes)
    words = list(at)
    speaking, carries = _speaking(words, text_of, word_of, y)
    seen = np.bincount(word_of[y[text_of] == 0], minlength=len(words))
    common = [words[i] for i in np.argsort(-seen, kind="stable")[:100] if seen[i]]
    landmarks = _unlike(common, _unlike(speaking, [], len(speaking)), COMMON_LANDMARKS) if speaking else []
    if not landmarks:
        return None
    gram = similarities(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
    white = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    sim = similarities(words, landmarks)
    shared = np.bincount(word_of[(y[text_of] == 1) & carries[word_of]], minlength=len(words))
    changed, like = _with_insertions(words, shared)
    sim_changed = similarities(changed, landmarks)
    rank = np.where(carries, 1.0, sim.max(1) - 1)
    for _ in range(rounds):
        # each sentence by its highest word
        high = np.maximum.reduceat(rank[word_of], starts)
        best = np.minimum.reduceat(np.where(rank[word_of] == np.repeat(high, sentence_sizes), word_of, len(words)), starts)
        toxic = y[sentence_text] == 1
        pos, neg = np.bincount(best[toxic & (high > 0)], minlength=len(words)), np.bincount(best[~toxic], minlength=len(words))
        i, j = np.flatnonzero(pos), np.flatnonzero(neg)
        if not len(i) or not len(j):
            return None
        more = np.flatnonzero(pos[like] > 3 * neg[like])  # changed forms of words that are positive beyond doubt
        x = np.concatenate([sim[i], sim_changed[more], sim[j]]) @ white
        weight = np.concatenate([pos[i], pos[like[more]] * CHANGED, neg[j]]).astype(float)
        w = _svm(x, np.where(np.arange(len(x)) < len(i) + len(more), 1.0, -1.0), np.sqrt(weight))
        rank = sim @ (white @ w[:-1]).astype(np.float32) + w[-1]
    total = _summed(rank[word_of], text_of, len(y))
    n = [len(low.split()) + len(spelled(low)) for low in map(str.lower, texts)]
    share = np.array([1.0, 1.0]) if population is None else np.array(population, float) / np.maximum(1, np.bincount(y, minlength=2))
    weight = share[y] * len(y) / share[y].sum()
    return ToxicityModel(landmarks, (white @ w[:-1]).astype(np.float32), float(w[-1]), _logistic(_of_text(total, n), y.astype(float), weight))


def _summed(margins: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """By text the sum of the positive margins, 1 at most each."""
    return np.bincount(text_of, np.clip(margins, 0, 1), texts)


def train(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Fits, in one task, on max_texts texts of each label at most."""
    labelled = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    bounded, counts = None, {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for k in (0, 1):  # the ids first, so that the sort doesn't carry texts
        part = labelled.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_texts)
        bounded = part if bounded is None else bounded.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(bounded), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        texts, marks, chars = [], [], [0, 0]
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if chars[label] < MAX_TRAINING_CHARS:
                    chars[label] += len(text)
                    texts.append(text)
                    marks.append(label)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, marks, (counts.get(0, 0), counts.get(1, 0))))], pa.binary())], ["model"])

    # text breaks ties of repeated ids, so that the sample does not depend on partitions
    ordered = rows.orderBy(F.xxhash64("id"), "id", "text").coalesce(1).select("text", "label")
    found = ordered.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def _text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, spelled ones included, and the text of each."""
    low = pc.utf8_lower(texts)
    split = pc.utf8_split_whitespace(low)
    words, text_of = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    more, of = [], []
    for i in np.flatnonzero(pc.match_substring_regex(low, MAY_BE_SPELLED).to_numpy(zero_copy_only=False)).tolist():
        found = spelled(low[i].as_py())
        more += found
        of += [i] * len(found)
    if more:
        words, text_of = pa.concat_arrays([words, pa.array(more, pa.string())]), np.concatenate([text_of, np.array(of, text_of.dtype)])
    return words, text_of


def score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None, out_col: str = "toxicity") -> DataFrame:
    """The columns in keep and out_col, a score from 0 to 1."""
    keep = docs.columns if keep is None else keep
    held_text = fresh("text", keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(held_text))
    if model is None:
        return rows.drop(held_text).withColumn(out_col, F.lit(0.0))
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        known: dict[str, float] = remembered(("margins", key), dict)

        def learn(new: list[str]) -> None:
            """Sum of the positive margins of each word's units."""
            for s in range(0, len(new), WORDS_AT_ONCE):
                part = new[s : s + WORDS_AT_ONCE]
                cut = [units(t) for t in part]
                of = np.repeat(np.arange(len(part)), [len(x) for x in cut])
                margins = own.margins([u for x in cut for u in x]) if len(of) else np.zeros(0)
                known.update(zip(part, _summed(margins, of, len(part)).tolist(), strict=True))

        for whole in batches:
            for b in parts_of([whole], BATCH_BYTES, whole.num_columns - 1):
                if len(known) > REMEMBERED:
                    known.clear()
                words, text_of = _text_words(b.column(b.num_columns - 1))
                code = words.dictionary_encode()
                names = code.dictionary.to_pylist()
                learn([w for w in names if w not in known])
                values = np.array([(known[w], w != "") for w in names], float).reshape(-1, 2)[code.indices.to_numpy()]
                total, n = (np.bincount(text_of, values[:, k], b.num_rows) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.score(total, n))], names=[*b.schema.names[:-1], out_col])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, rows.drop(held_text).schema.add(out_col, "double"))
