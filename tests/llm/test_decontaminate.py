import pickle
import random

import pytest
from granary.llm import decontaminate as dc


def words(text):
    out, w = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            out += [w] if w else []
            w = ""
        else:
            w += c
    return out


def brute(docs, items, window=10):
    pats = [(str(i), words(t)) for i, t in items if i is not None]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, p in pats:
            m = min(window, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if m and tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(name)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    rows = df.select("doc_id", "n_words", "hit_start", "hit_end", "items").collect()
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in zip(r.hit_start, r.hit_end)), list(r["items"])) for r in rows), key=str)


@pytest.mark.parametrize("window,shard", [(10, 1 << 20), (3, 1 << 20), (4, 150)])
def test_against_brute_force(spark, window, shard):
    rnd = random.Random(window)
    v = ["a", "B", "c1", "é", "dd"]
    text = lambda n: rnd.choice([" ", ", ", "-\n"]).join(rnd.choice(v) for _ in range(n))
    items = [(i, text(rnd.randint(0, 14))) for i in range(14)] + [(3, "a a"), (None, "a"), (99, None), (98, "")]
    docs = [(i, text(rnd.randint(0, 900 if i == 3 else 60))) for i in range(40)]
    docs += [(100 + i, f"pre {t} post") for i, (_, t) in enumerate(items) if t]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(dc.decontaminate(d, b, window, shard)) == brute(docs, items, window)


def test_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = dc.decontaminate(awkward, items)
    assert got(out) == brute(rows, [(1, "one two")])
    assert set(awkward.columns) <= set(out.columns)
    assert dc.op6_decontaminate(empty, items).count() == 0
    assert dc.op6_decontaminate(awkward, items.limit(0)).filter("contaminated").count() == 0


def test_what_is_sent_is_bounded_and_the_table_stays_sparse():
    """2 MB of items of invented words: bytes sent for each byte of text, and the share of blocks that stop a jump."""
    rnd = random.Random(3)
    items = [(str(i), " ".join(f"{rnd.choice('bcdfgh')}{rnd.randrange(1 << 16):x}" for _ in range(200))) for i in range(1_700)]
    size = sum(len(t) for _, t in items)
    groups = dc.build_groups(items, 10)
    assert len(pickle.dumps(groups)) <= size * dc.SENT_BYTES / dc.SHARD_BYTES
    assert all((g.shift == 0).mean() <= 1 / dc.SPARSE for g in groups)


def test_shards_larger_than_the_bound_are_halved(spark):
    items = [(str(i), f"a{i} b{i} c{i} d{i}") for i in range(40)]
    df = spark.createDataFrame(items, "item_id string, text string")
    shards = list(dc.shards_of(df, 3, 1 << 20, 6_000))
    assert len(shards) > 1 and all(len(pickle.dumps(s)) <= 6_000 for s in shards)
    assert sorted({n for s in shards for g in s for n in g.words.names}) == sorted(i for i, _ in items)
    with pytest.raises(ValueError):
        list(dc.shards_of(df, 3, 1 << 20, 100))
