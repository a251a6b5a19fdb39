import hashlib
import random

import pytest
from granary.llm import exact_dedup as ed
from pyspark.sql import functions as F


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        first = True
        for i in ids:
            out.append((i, best, len(ids), i == best and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != best
    return sorted(out, key=str)


def got(df):
    rows = df.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def texts(seed, n=200):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abABé") for _ in range(rnd.choice([0, 1, 3, 4, 5, 8, 9, 16, 31, 33, 70]))) for _ in range(60)]
    pool += [p + "x" for p in pool[:20]] + [p[:-1] for p in pool[:20]] + [p * 2 for p in pool[:20]]
    return [(rnd.randrange(-50, 400), rnd.choice([t, t.upper().replace("É", "é"), t])) for t in (rnd.choice(pool) for _ in range(n))]


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 4), (3, 7), (4, 4096)])
def test_against_brute_force(spark, seed, block):
    rows = texts(seed) + [(None, "abc"), (None, "ABC"), (3, None), (4, ""), (9, "É"), (10, "é")] + [(77, "fifty")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ed.identities(df, block)) == brute(rows)


@pytest.mark.parametrize("values", [1, 3])
def test_blocks_of_one_hash_are_told_apart(spark, monkeypatch, values):
    """With a hash of so few values every block meets others: names come from the bytes."""
    monkeypatch.setattr(ed, "_hash", lambda b, k=values: sum(b) % k)
    rows = texts(5, 120) + [(1, "same"), (1, "emas"), (1, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(ed.identities(df, 4)) == brute(rows)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(ed.identities(awkward)) == brute(rows)
    assert ed.op13_exact_dedup(empty).count() == 0 and ed.drop_copies(empty).columns == empty.columns
    kept = ed.drop_copies(awkward)
    assert kept.columns == awkward.columns
    largest = {}
    for i, t in rows:
        largest[lower(t)] = max(largest.get(lower(t), i), i, key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), lower(r.text)) for r in kept.collect()) == sorted((str(i), t) for t, i in largest.items())


def test_names_are_places_in_the_order_of_blocks(spark):
    df = spark.createDataFrame([(k, b) for b, k in ((bytearray(b"b"), 5), (bytearray(b"a"), 5), (bytearray(b"z"), 1))], "h long, block binary")
    rows = sorted((r["name"], r["h"], bytes(r["block"])) for r in ed._named(df, ["h", "block"], "t").collect())
    assert [x[1:] for x in rows] == [(1, b"z"), (5, b"a"), (5, b"b")]


def test_a_third_of_all_rows_in_one_group(spark):
    """The block that they share is one row of each task in the exchange."""
    rows = [(i, "same text " * 50 if i % 3 == 0 else f"own {i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = ed.op13_exact_dedup(df).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in out} == {(1, True, 2_000), (1_000, True, 1), (1_000, False, 999)}
    found = df.select("text").mapInArrow(ed._contents(64), "h long, block binary, c long").groupBy("block").count().agg(F.max("count")).first()[0]
    assert found <= 4
