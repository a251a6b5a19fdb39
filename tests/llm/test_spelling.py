import random
import re
import zlib

import pytest
from granary.llm import spelling as sp

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_vocabulary(rows, length=6, occurrences=5, noise=199):
    count = {}
    for i, t in rows:
        for w in LETTERS.findall(t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                count[w] = count.get(w, 0) + 1
    return {w: n for w, n in count.items() if n >= occurrences}


def near(a, b):
    """One inserted, deleted or replaced code point parts the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(count, ratio=5):
    around = {w: [] for w in count}
    for a in count:
        for b in count:
            if a < b and abs(len(a) - len(b)) <= 1 and near(a, b):
                around[a].append(b)
                around[b].append(a)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        if best is not None and count[best] >= ratio * count[w]:
            form[w] = best
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), count[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def edited(rnd, w, letters):
    k = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:k] + rnd.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k + 1 :]])


def texts(seed, n_words=12, n_docs=150):
    rnd = random.Random(seed)
    letters = "abcdeéÀÿßz"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 11))) for _ in range(n_words)]
    for k in range(1, 4):  # each generation is larger, rarer, and an edit away from the one before
        words += [edited(rnd, rnd.choice(words[-n_words * 2 :]), letters) for _ in range(n_words * k)]
    weights = [1 / (k + 1) ** 1.6 for k in range(len(words))]
    breaks = [" ", "\n", "--", "1", "×x", "ă", "_"]
    return [(i * 7, "".join(rnd.choice([w, w.upper(), w.title()]) + rnd.choice(breaks) for w in rnd.choices(words, weights, k=rnd.randint(0, 200)))) for i in range(n_docs)]


@pytest.mark.parametrize("seed,noise,length,occurrences", [(1, 199, 6, 5), (2, 3, 6, 5), (3, 7, 4, 2)])
def test_against_brute_force(spark, seed, noise, length, occurrences):
    rows = texts(seed) + [(None, "zzaabbé " * 9)] * 2 + [(5, None), (6, ""), (6, "× ÷ 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = brute_vocabulary(rows, length, occurrences, noise)
    want = brute(count)
    assert got(sp.spelling_variants(df, length, occurrences, noise)) == want
    assert sum(w[1] is not None for w in want) > 10
    if noise < 199:  # forms of forms
        assert any(w[1] is not None and w[2] != w[1] for w in want)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(sp.spelling_variants(awkward, 3, 2)) == brute(brute_vocabulary(rows, 3, 2))
    fifty = spark.createDataFrame([(1, "Colour colour"), (2, "color ... other")] * 50, "doc_id long, text string")
    assert got(sp.spelling_variants(fifty, 5, 5)) == brute(brute_vocabulary([(1, "Colour colour"), (2, "color ... other")] * 50, 5, 5))
    assert sp.op12_spelling(empty).count() == 0


def test_runs_go_on_over_pieces(monkeypatch):
    monkeypatch.setattr(sp, "PIECE", 7)
    for t in ("abcdefghij", "abc defghi jkl", "abcdef ghijklm", "      abcdefg", "1234567abc", ""):
        assert [w for found in sp._runs(t, LETTERS) for w in found] == LETTERS.findall(t)


def test_every_edit_meets_in_a_bucket(spark):
    """All words one edit away from some seeds, whatever the place and the letters."""
    seeds = ["banana", "aaaaaa", "zéàzzéà"]
    words = set(seeds)
    for w in seeds:
        for k in range(len(w) + 1):
            words |= {w[:k] + c + w[k:] for c in "abzéÿ"} | {w[:k] + c + w[k + 1 :] for c in "abzéÿ"} | {w[:k] + w[k + 1 :]}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for a in words for b in words if a != b and near(a, b)}
    assert {tuple(r) for r in sp.near_words(df).collect()} == want


def test_a_hot_word_is_one_row_of_each_batch(spark):
    """The exchange before the sum carries distinct words of batches, not occurrences."""
    df = spark.createDataFrame([(i, "frequent " * 400) for i in range(300)], "doc_id long, text string").coalesce(2)
    assert [tuple(r) for r in sp.vocabulary(df, noise=10**9).collect()] == [("frequent", 120_000)]
    rows = df.mapInArrow(sp.word_counts(6, 10**9), "word string, n long")
    assert rows.count() <= 4
