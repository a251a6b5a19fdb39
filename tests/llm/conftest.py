"""Awkward tables that every operator has to take."""

import random

import pytest

#: Columns named like ones that operators add or use inside.
EXTRA = "part int, rep long, vid long, n_shingles long, score double, slot long, shard string, fps string, items string, n_words int, _id int, _gone int, label int"


@pytest.fixture(scope="session")
def awkward(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    near = list(base)
    near[7] = "changed"
    lines = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(12)]
    texts = [
        (1, " ".join(base)), (2, None), (3, ""), (None, " ".join(base)), (4, " \n\t \n"), (5, " ".join(rnd.choice(words) for _ in range(60_000))),
        *[(6, " ".join(base))] * 50, (7, " ".join(near)), (8, "one two"), (9, "One TWO"), (10, "\n".join(lines)),
        (11, "\n".join(lines[3:9])), (12, "x\n\n" + "\n".join(lines[2:5]) + "\n"), (13, "é ñ 日本 😀 <|endoftext|> 'll   z"), (14, "a" * 70_000),
        (6, "other text of the same id"), (None, None), (15, "Idiot! You are pathetic.\nShe said he is not stupid."), (16, "\x00 nul \x7f"),
        (17, "x" + " " * 1_000_000 + "y"), (18, "\n" * 300_000),
    ]
    rows = [(i, t, "en", "s", len(t or ""), *([0] * 5), *["x"] * 3, 1, 2, 3, 4) for i, t in texts]
    rows = [(i, t, g, s, n, 1, 2, 3, 4, 0.5, 6, "x", "y", "z", 1, 2, 3, 4) for i, t, g, s, n, *_ in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


def corpus(seed, n, vocabulary=40, longest=40, copies=0.4, line=None):
    """(id, text): random texts, some of them copies with a few words changed."""
    rnd = random.Random(seed)
    words = [f"{c}{i}" for i in range(vocabulary) for c in "aB"][:vocabulary]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < copies:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 3)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                k = rnd.randint(0, len(t))
                t = t[k:] + t[:k]
        else:
            t = [rnd.choice(words) for _ in range(rnd.randint(0, longest))]
        texts.append(t)
    return [(3 * i + 1, (line or " ").join(t)) for i, t in enumerate(texts)]
