import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.llm import decontamination, language_model, pseudonyms, quality_rules, toxicity, url_filter


def distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(4)
    for _ in range(400):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(2))
        for k in range(4):
            # a pattern that may be dropped whole matches the empty part of any text
            assert decontamination.Myers(p).within(t, k) == (distance_within(p, t) <= k), (p, t, k)


def test_decontamination(spark, docs_of):
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short"), (None, item)], "item_id long, text string")
    docs = docs_of([None, "", "xx " + item.upper().replace(" ", "\n ") + " yy", "aa " + item.replace("quick", "quiet") + " b", "nothing like it", item[:30]])
    got = {r.id: r.item_ids for r in decontamination.matches(docs, bench).collect()}
    assert got == {0: [], 1: [], 2: [1, 2], 3: [1, 2], 4: [], 5: []}
    assert decontamination.matches(docs.limit(0), bench).count() == 0 and decontamination.matches(docs, bench.limit(0)).count() == 6


def test_short_items_match_at_word_boundaries():
    own = decontamination.Matcher([(1, "Who won?"), (2, "forty two"), (3, "the answer is forty"), (4, ""), (5, "e")])
    assert own.find("so: who  WON? nobody") == [1] and own.find("forty two") == [2] and own.find("E") == [5]
    assert own.find("fforty two, forty twos") == [] and own.find("forty twp") == [] and own.find("") == []
    assert own.find("see: the answr is forty.") == [3] and own.find("the answer is fortyish") == [] and own.find("xthe answer is forty") == [3]
    r = random.Random(5)
    for _ in range(300):
        item, text = ("".join(r.choice("ab ") for _ in range(n)).strip() for n in (r.randrange(17, 22), 40))
        item, text = decontamination.normal(item), decontamination.normal(text[:9] + item[:8] + r.choice(["", "a", " "]) + item[8 + r.randrange(2):] + text[9:])
        k = int(decontamination.EDIT_RATE * len(item))
        spans = [text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1) if decontamination.bounded(text, a) and decontamination.bounded(text, b) and abs(b - a - len(item)) <= k]
        assert decontamination.Matcher([(1, item)]).find(text) == [1] * any(decontamination.distance(item, x) <= k for x in spans), (item, text)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c = Counter(windows)
    covered = {j for i, w in enumerate(windows) if c[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules_equal_brute_force(docs_of):
    r = random.Random(6)
    texts = [None, "", " \n\t ", "a", "x y\nx y\nx y", "  \x85 # a&b", "For " * 50]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "a\n", "# ", "é ", "\x0b"]) for _ in range(r.randrange(120))) for _ in range(150)]
    got = {r.id: r for r in quality_rules.judge(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        n = brute_quality(t)
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == n, repr(t)
        assert g.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (g.base_failed and g.kept)


def test_decontamination_against_all_places(docs_of):
    """Items with edits, repeated pieces, ties and copies, against the distance to the whole text."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(r.randrange(6, 30)))) for k in range(8)]
    items += [(20, "ab ab ab ab ab ab ab ab ab ab"), (21, items[0][1]), (22, None), (None, "abc abc")]
    texts = [None, "", "ab " * 400, "ab" * 300]
    for _ in range(60):
        item = list(r.choice(items[:9])[1])
        for _ in range(r.randrange(4)):
            item[r.randrange(len(item))] = r.choice(["", "x", "  ", "yz"])
        texts.append(" ".join([word() for _ in range(r.randrange(30))] + ["".join(item)] + [word() for _ in range(r.randrange(30))]))
    got = {x.id: x.item_ids for x in decontamination.matches(docs_of(texts), docs_of([]).sparkSession.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = decontamination.normal(t or "")
        want = [k for k, x in items if k is not None and x and distance_within(x, t) <= int(decontamination.EDIT_RATE * len(x))]
        assert got[i] == sorted(want), t


def test_toxicity(spark, docs_of):
    r = random.Random(8)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randrange(1, 5)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(20)]
        labels.append(i % 2)
        if i % 2:
            words.insert(r.randrange(20), r.choice(["moron", "idiot", "scumbag"]))
        texts.append(" ".join(words))
    model = toxicity.fit(texts, labels)
    docs = docs_of(["you moron there", "you mor-on there", "you m o r o n there", "you moxron there", "the other reinon", "", None])
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert min(got[0], got[1], got[2]) >= 0.7 and got[3] > got[4] and max(got[4], got[5], got[6]) < 0.7
    assert toxicity.fit(texts, [0] * 400) is None and toxicity.score(docs, None, keep=["doc_id"]).select("toxicity").distinct().count() == 1
    assert toxicity.score(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_toxicity_covers_any_number_of_unlike_insults():
    r = random.Random(9)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    insults = [word(8, "bcdfghjklmpquvwxyz") for _ in range(60)]
    plain = [word(r.randrange(4, 9), "aeinorst") for _ in range(300)]
    texts = [" ".join([r.choice(plain) for _ in range(20)] + [insults[i // 2 % 60]] * (i % 2)) for i in range(3000)]
    model = toxicity.fit(texts, [i % 2 for i in range(3000)])
    in_text = lambda words: model.score(np.clip(model.margins(words), 0, 1), [21] * len(words))
    assert (in_text(insults) >= 0.7).all() and (in_text(plain) < 0.7).all()


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = host.lower(), slash + path
    fits = []
    for e, v in url_filter.RULES:
        h, p = e.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(e), e))
    return host, path, max(fits)[1] if fits else None


def test_url_filter(spark):
    urls = [None, "", "x", "http://a.org", "http://a.org/", "HTTPS://B.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2?x=/en/1", "ftp://org/", "http://x.com/fr/#a", "http://com/de/", "http://notorg/", "http://m.adult-x.example.com/1", "http://u:p@Adult-X.example.com:80/%7Ea//b", "http://spam-farm.example.net.", "http://spam-farm.example.net", "http://x.com/FR/", "http://a.org?q", "http://a.b.example.org/en/1", "http://a.b.example.org/en/1"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.standard_entries(spark)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute_verdict(urls[r.id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.id]
        assert r.verdict == (dict(url_filter.RULES)[rule] if rule else "block" if "adult-x" in host or "spam-farm" in host else "allow")


def test_listed_urls_of_any_number(spark, monkeypatch):
    """Canonical forms; a list joined by shuffle, a filter that passes much, an empty list, ties: the same verdicts."""
    r = random.Random(7)
    part = lambda: "".join(r.choice("abc") for _ in range(2))
    entries = [(f"http://{part()}.{part()}.net/{part()}" + r.choice(["", "/", "/" + part()]), r.choice(["block", "allow"]), False) for _ in range(300)]
    entries += [("HTTP://U@AA.bb.net.:8080/%61//./b?x#y", "block", False), ("aa.bb.net/ab/", "allow", False), (None, "block", None), ("  ", "block", False), ("cc.net/a", "allow", True)]
    urls = [f"https://{part()}.{part()}.{part()}.net{r.choice(['', ':1', '.'])}/{part()}/{part()}" for _ in range(400)] + ["http://aa.bb.net/a/bc", "http://x.cc.net/ab", "http://x.cc.net/%61b"]
    pages = spark.createDataFrame([*enumerate(urls), (None, None), (0, urls[0])], "page_id long, url string")
    listed = {}
    for e, v, rule in entries:
        if e and e.strip() and not rule:
            k = url_filter.canonical_entry(e)
            listed[k] = max(v, listed.get(k, ""))
    want = []
    for u in [*urls, None, urls[0]]:
        host, path, _ = brute_verdict(u)
        fits = [len(e) for e in ["cc.net/a"] if (host == "cc.net" or host.endswith(".cc.net")) and path.startswith("/a")]
        h, p = url_filter.canonical(host, path)
        own = [(len(k), k) for k in listed if host and (h == k.split("/")[0] or h.endswith("." + k.split("/")[0])) and p.startswith("/" + k.split("/", 1)[1])]
        want.append((host, path, "cc.net/a" if fits else None, "allow" if fits or not own else listed[max(own)[1]]))
    schema = "entry string, verdict string, is_rule boolean"
    for limit, blocks in ((10**6, 10**6), (10, 10**6), (10, 1)):
        monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", limit)
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
        got = url_filter.judge_urls(pages, spark.createDataFrame(entries, schema)).collect()
        assert sorted((tuple(x)[1:] for x in got), key=str) == sorted(want, key=str)
    assert {x.verdict for x in url_filter.judge_urls(pages, spark.createDataFrame([], schema)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(entries, schema)).count() == 0


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    bloom = url_filter.BlockedBloom.build(h)
    assert bloom.may_hold(h).all() and bloom.may_hold(np.random.default_rng(2).integers(-(2**63), 2**63, 20000)).mean() < 0.05


def test_pseudonyms(docs_of):
    own = pseudonyms.Pseudonyms(b"key")
    for size in (1, 2, 10, 257, 1000):
        p = pseudonyms.Permutation(b"key", "x", size)
        out = [p.forward(i) for i in range(size)]
        assert sorted(out) == list(range(size)) and [p.backward(x) for x in out] == list(range(size))
    text = "Mail bob.42@mail8.example.com or +1 (386) 555-3733, card 4111 1111 1111 1111, at 42.144.35.254 on 2020-02-29, id 123-45-6789, DE89 3704 0044 0532 0130 00."
    new, spans = own.text(text)
    assert [k for k, _, _ in spans] == ["email", "phone", "card", "ip", "date", "ssn", "iban"]
    for k, a, b in spans:
        assert text[a:b] not in new
    card = re.search(r"card ([\d ]+),", new)[1]
    assert pseudonyms.luhn(card.replace(" ", "")) == 0 and own.text(new)[1] and [k for k, _, _ in own.text(new)[1]] == [k for k, _, _ in spans]
    assert own.text(text) == pseudonyms.Pseudonyms(b"key").text(text) and own.text(text)[0] != pseudonyms.Pseudonyms(b"other").text(text)[0]
    clean = "Version 1.2.3.4.5, page 4887, 1234567890123456 and 300.1.1.1 on 2021-02-30 at 10:30."
    assert own.text(clean) == (clean, [])
    rows = pseudonyms.pseudonymise(docs_of([None, "", text, clean]), b"key", spans_col="found").orderBy("doc_id").collect()
    assert rows[0].text is None and rows[1].text == "" and len(rows[2].found) == 7 and rows[3].text == clean


@pytest.mark.parametrize("kind, value", [("date", "12/31/1984"), ("date", "2024/01/02"), ("date", "1/2/2024"), ("date", "1.2.2024"), ("date", "1-2-2024"), ("date", "2020-02-29"), ("email", "a@b.org"), ("ip", "1.2.3.4"),
    ("ssn", "123-45-6789"), ("phone", "+1 (386) 555-3733"), ("phone", "(386) 555-3733"), ("card", "4111111111111111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "XX93ABCDEFGHIJKL")])
def test_each_value_alone_in_a_text(kind, value):
    own = pseudonyms.Pseudonyms(b"key")
    new, spans = own.text(f"on {value} we")
    assert spans == [(kind, 3, 3 + len(value))] and value not in new
    assert own.text(f"on {value} we, a@b.org")[0].startswith(new)


def test_numbers_stay_in_their_plan():
    own, r = pseudonyms.Pseudonyms(b"key"), random.Random(4)
    numbers = {f"({r.randrange(2, 10)}{r.randrange(100):02}) {r.randrange(2, 10)}{r.randrange(100):02}-{r.randrange(10000):04}" for _ in range(1000)}
    new = {v: own.phone(v) for v in numbers}
    assert len(set(new.values())) == len(numbers)
    for v, w in new.items():
        assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", w) and own.phone(f"+1 {v}") == f"+1 {w}"
    odd = {own.phone(f"+1 {k:010}") for k in range(500)}
    assert len(odd) == 500 and not any(re.fullmatch(r"\+1 [2-9]\d\d[2-9]\d{6}", w) for w in odd)


@pytest.mark.parametrize("value, shape", [("1/2/2020", r"\d{1,2}/\d{1,2}/\d{4}"), ("01/02/2020", r"\d\d/\d\d/\d{4}"), ("12/31/1984", r"\d\d/\d\d/\d{4}"), ("3.4.1999", r"\d{1,2}\.\d{1,2}\.\d{4}"), ("2020-02-29", r"\d{4}-\d\d-\d\d")])
def test_dates_keep_their_format(value, shape):
    days = [pseudonyms.Pseudonyms(str(k).encode()).date(value) for k in range(60)]
    assert all(re.fullmatch(shape, d) for d in days)
    if value == "1/2/2020":
        assert any(len(d) < 10 for d in days) and not any(x.startswith("0") for d in days for x in d.split("/"))


def test_pseudonyms_against_planted_values(docs_of):
    """Values planted in prose are replaced, all else stays, equal values stay equal; ties, repeats, a very long text."""
    r, own = random.Random(6), pseudonyms.Pseudonyms(b"key")
    values = ["a.b@c.org", "123-45-6789", "4111 1111 1111 1111", "10.20.30.40", "(386) 555-3733", "2001-02-03"]
    texts = []
    for _ in range(30):
        texts.append([r.choice(values) if r.random() < 0.2 else r.choice(["word", "Haus,", "né", "12", "x."]) for _ in range(40)])
    texts.append(["word", "10.20.30.40", "\n"] * 60_000)
    want = [" ".join({v: getattr(own, k)(v) for k, v in zip(("email", "ssn", "card", "ip", "phone", "date"), values, strict=True)}.get(w, w) for w in t) for t in texts]
    docs = docs_of([" ".join(t) for t in texts])
    rows = {x.doc_id: x.text for x in pseudonyms.pseudonymise(docs.union(docs), b"key", spans=False).collect()}
    assert [rows[i] for i in range(len(texts))] == want
    assert pseudonyms.pseudonymise(docs_of([]), b"key", spans=False).count() == 0


def test_language_model(docs_of):
    r = random.Random(3)
    texts = [None, "", " "] + [" ".join(r.choice(["the", "théa", "On", "reon", "thon", f"w{r.randrange(99)}"]) for _ in range(r.randrange(60))) for _ in range(80)]
    train = (F.crc32(F.col("doc_id").cast("string")) % 7) != 2
    got = {x.id: x for x in language_model.score(docs_of(texts), train).collect()}
    words = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert g.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert g.score < 0
    assert language_model.score(docs_of([]), train).count() == 0
