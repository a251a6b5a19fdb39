"""Operators of places against plain loops."""

import random
import zlib

import numpy as np
import pytest
from granary.functions import checksums as cs
from granary.functions import numbers, text
from granary.operators import frames, matching, offsets, overlap, pieces, rounds
from granary.sources import ranges
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def stored(spark, *data):
    rows = [(k, f"f{k}", len(d), d) for k, d in enumerate(data)]
    return ranges.located(spark.createDataFrame(rows, "entry long, path string, size long, content binary"))


def spans(rnd, n, longest):
    out = []
    for _ in range(n):
        s = rnd.randrange(-2_000, 50_000)
        out.append((rnd.choice([1, 1, 1, 2, None]), s, rnd.choice([s, s + 1, s + rnd.randrange(longest), s + rnd.randrange(200), None])))
    return out


@pytest.mark.parametrize("seed,longest", [(1, 50), (2, 5_000), (3, 10**9)])
def test_overlaps_against_a_loop(spark, seed, longest):
    rnd = random.Random(seed)
    a, b = spans(rnd, 150, longest), spans(rnd, 150, 300) + [(1, 0, 1 << 55), (2, -(1 << 40), 3)]
    left = spark.createDataFrame(a, "e long, s long, t long").repartition(3)
    right = spark.createDataFrame(b, "e long, u long, v long")
    got = overlap.overlapping(left, right, "e", ("s", "t", "u", "v")).select("left.*", "right.u", "right.v").collect()
    sound = lambda rows: [r for r in rows if None not in r and r[1] < r[2]]
    want = [(*x, y[1], y[2]) for x in sound(a) for y in sound(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert sorted(tuple(r) for r in got) == sorted(want)
    points = spark.createDataFrame([(e, s) for e, s, _ in a] + [(1, None)], "e long, at long")
    out = overlap.outside(points, right, "e", "at", "u", "v").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((e, s)) for e, s in [(e, s) for e, s, _ in a] + [(1, None)] if not any(y[0] == e and s is not None and y[1] <= s < y[2] for y in sound(b)))
    none = right.limit(0)
    assert overlap.overlapping(left, none, "e", ("s", "t", "u", "v")).count() == 0 and overlap.outside(points, none, "e", "at", "u", "v").count() == points.count()


def test_a_hot_bin_gives_no_more_than_its_pairs(spark):
    """Spans of all lengths at one place and many elsewhere: joined rows stay near the pairs, whatever the longest span is."""
    n = 3_000
    a = spark.range(n).select(F.lit(1).alias("e"), (F.col("id") * 40).alias("s"), (F.col("id") * 40 + 30).alias("t"))
    b = a.select("e", F.col("s").alias("u"), F.col("t").alias("v")).unionByName(spark.createDataFrame([(1, 0, 1 << 50), (1, 7, 9)], "e int, u long, v long"))
    assert overlap.overlapping(a, b, "e", ("s", "t", "u", "v")).count() == n + n + 1
    dealt = overlap._dealt(b, "e", "u", "v", "r", [0, 12])
    assert dealt.count() <= 2 * 2 * (n + 2) and dealt.groupBy("_level", "_bin").count().filter("_level = 0").agg(F.max("count")).first()[0] <= 5


def test_pieces_against_a_loop(spark):
    rnd = random.Random(4)
    data = [bytes(rnd.randrange(1, 256) for _ in range(500)) for _ in range(2)]
    rows, streams = [], {}
    for s in range(12):
        whole = b""
        for k in range(rnd.randrange(0, 8)):
            n = rnd.randrange(0, 40)
            off = rnd.choice([None, rnd.randrange(0, 450)])
            rows.append((s, k, off, n))
            whole += bytes(n) if off is None else data[s % 2][off : off + n]
        streams[s] = whole
    wanted = [(s, j, a, a + rnd.randrange(0, 120), s % 2) for s in range(13) for j, a in enumerate((0, rnd.randrange(0, 150), 10_000))]
    df = spark.createDataFrame(rows, "s long, k int, off long, n long")
    ask = spark.createDataFrame(wanted, "s long, j int, a long, b long, file long")
    found = pieces.slices(df, ask, "s", "k", "off", "n", "a", "b")
    got = {(r.s, r.j): bytes(r["bytes"]) for r in pieces.gathered(found, ["s", "j"], stored(spark, *data), "file").collect()}
    want = {(s, j): (streams.get(s, b"") + bytes(20_000))[a:b] for s, j, a, b, _ in wanted if a < b}
    assert got == want


def runs_by_loop(passed, least):
    out, n = [], 0
    for i, ok in enumerate([*passed, False]):
        if ok:
            n += 1
        else:
            if n >= least:
                out.append((i - n, n))
            n = 0
    return out


@pytest.mark.parametrize("chunk", [1, 16, 48, 160, 1 << 20])
def test_runs_do_not_depend_on_chunks(spark, chunk):
    """Runs in gaps, leading and trailing ones too, over any number of chunk borders."""
    rnd = np.random.default_rng(7)
    data = [rnd.choice([0, 0, 0, 0, 0, 0, 1], n).astype(np.uint8).repeat(16).tobytes() for n in (300, 41, 1, 0)] + [bytes(16 * 64), b"\1" * 77]
    quiet = lambda f: (f == 0).all(axis=1)
    gaps = [(0, 0, 1_000), (0, 1_008, 1_011), (0, 1_600, 4_800), (1, 0, 656), (2, 0, 16), (4, 0, 1_024), (4, 3, 1_000), (5, 0, 77)]
    df = spark.createDataFrame(gaps, "entry long, start long, end long")
    want = []
    for e, a, b in gaps:
        part = np.frombuffer(data[e][a : a + (b - a) // 16 * 16], np.uint8).reshape(-1, 16)
        want += [(e, a, i, n) for i, n in runs_by_loop(quiet(part), 4)]
    got = frames.frame_runs(stored(spark, *data), df, 16, quiet, 4, chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    values = spark.createDataFrame([(k, d) for k, d in enumerate(data)] + [(9, None)], "k long, v binary")
    want = [(k, i, n) for k, d in enumerate(data) for i, n in runs_by_loop(quiet(np.frombuffer(d[: len(d) // 16 * 16], np.uint8).reshape(-1, 16)), 3)]
    assert sorted(tuple(r) for r in frames.value_runs(values, "k", "v", 16, quiet, 3, chunk).collect()) == sorted(want)


def test_first_larger_against_a_loop(spark):
    rnd = random.Random(5)
    rows = []
    for g, n, kind in ((1, 700, "any"), (2, 300, "falling"), (3, 300, "rising"), (4, 1, "any"), (5, 80, "equal"), (None, 9, "any")):
        for k in range(n):
            v = {"any": rnd.randrange(90), "falling": 1_000 - k, "rising": k, "equal": 7}[kind]
            rows.append((g, k, None if rnd.random() < 0.05 else v, -1 - (g or 0)))
    want = []
    for i, (g, k, v, e) in enumerate(rows):
        later = (r[2] for r in rows[i + 1 :] if r[0] == g and r[2] is not None and v is not None and r[2] > v)
        want.append((g, k, v, None if v is None else next(later, e)))
    df = spark.createDataFrame(rows, "g long, k int, v long, e long").repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:  # many stretches in each group
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = offsets.first_larger(df, "g", ["k"], "v", "e").select("g", "k", "v", "next").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def slow(c, data):
    crc, top, mask = c.preset, 1 << (c.width - 1), (1 << c.width) - 1
    for b in data:
        crc ^= b << (c.width - 8)
        for _ in range(8):
            crc = ((crc << 1) & mask) ^ (c.polynomial if crc & top else 0)
    return crc ^ c.final


KINDS = [cs.OGG, cs.SIXTEEN, cs.Checksum(8, 0x07), cs.Checksum(32, 0x1EDC6F41, 0xFFFFFFFF, 0xFFFFFFFF), cs.Checksum(16, 0x8005)]


@pytest.mark.parametrize("kind", KINDS)
def test_checksums_of_any_chunks(spark, kind):
    rnd = random.Random(6)
    data = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 700, 5_000)]
    for d in data:
        assert kind.whole(kind.plain(d), len(d)) == slow(kind, d)
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)] + [(9, None)], "k long, v binary")
    for chunk in (1, 64, 999, 10_000):
        some = df.filter("k < 5") if chunk == 1 else df
        got = {r.k: (r.n, r["checksum"]) for r in cs.checksum(cs.chunked(some, "k", "v", chunk).orderBy(F.rand(1)), ["k"], kind).collect()}
        assert got == {k: (len(d), slow(kind, d)) for k, d in enumerate(data) if chunk > 1 or k < 5}
    assert slow(cs.SIXTEEN, b"123456789") == 0xD64E and zlib.crc32(b"") == 0


def test_accepted_members_against_a_loop(spark):
    rnd = random.Random(8)
    claims = [(e, s, s + rnd.randrange(1, 60)) for e in (1, 2) for s in range(0, 2_000, 100)]
    members = [(e, s, s + rnd.randrange(1, 90), s * 7) for e in (1, 2, 3) for s in sorted(rnd.sample(range(2_000), 120))]
    want, count = [], {}
    upto = {}
    for e, s, t, x in members:
        if any(c[0] == e and c[1] <= s < c[2] for c in claims) or s < upto.get(e, 0):
            continue
        upto[e], count[e] = t, count.get(e, 0) + 1
        if count[e] <= 10:
            want.append((e, s, t, x))
    got = rounds.accepted(spark.createDataFrame(members, "entry long, s long, t long, x long"), spark.createDataFrame(claims, "entry long, s long, t long"), "entry", "s", "t", 10)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_merged_pairs_keep_the_left_row(spark):
    tracks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "track long, x string")
    pairs = spark.createDataFrame([(3, 1)], "left_key long, right_key long")
    assert sorted(tuple(r) for r in matching.merged_pairs(tracks, pairs).collect()) == [(2, "b", None, 1), (3, "c", 1, 2)]


def test_labels_that_can_be_shown(spark):
    given = ["abc.\n", "abc\r\n", "\u00a0abc\u3000", " a b ", "\u3000", "a\u00a0b", "", None, "~"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    found = {r.i: r.label for r in rows.select("i", text.printable(F.col("x")).alias("label")).collect()}
    assert [found[i] for i in range(len(given))] == [None, None, "abc", "a b", None, None, None, None, "~"]


def test_names_with_one_hash_are_told_apart(spark):
    names = ["http://a.example/100378", "http://a.example/104474", "http://a.example/1"]
    rows = spark.createDataFrame([(i, x.upper()) for i, x in enumerate(names)] + [(9, None)], "i int, x string").withColumn("h", numbers.name_hash("x"))
    listed = spark.createDataFrame([(x,) for x in [*names, names[0]]], "n string")
    found = matching.named_by_hash(rows, "h", listed, "n", "x")
    assert {r.i: r["name"] for r in found.collect()} == {**dict(enumerate(names)), 9: None} and found.columns == ["i", "x", "h", "name"]
    assert {r["name"] for r in matching.named_by_hash(rows.filter("i < 2"), "h", listed, "n").collect()} == {names[1]}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_outside_are_read_once(spark):
    points = spark.range(0, 4_000, 1, 2).select((F.col("id") % 3).alias("entry"), F.when(F.col("id") % 7 > 0, F.col("id") - 2_000).alias("at"))
    rnd = random.Random(4)
    rows = [(rnd.choice([0, 1, None]), s, s + rnd.choice([0, 3, 70, 900])) for s in (rnd.randrange(-2_100, 2_000) for _ in range(60))]
    out = overlap.outside(points, spark.createDataFrame(rows, "entry long, s long, e long"), "entry", "at", "s", "e")
    assert plan_of(out).count("Range (") == 1 and out.columns == ["entry", "at"]
    want = [(r.entry, r.at) for r in points.collect() if r.at is None or not any(e == r.entry and s <= r.at < t for e, s, t in rows)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_rounds_write_parents_only(spark, monkeypatch):
    """Numbers against a loop; the last and largest level is neither sorted nor written."""
    rnd, written, cut = random.Random(8), [], rounds.cut
    monkeypatch.setattr(rounds, "cut", lambda df, what: written.append(cut(df, what)) or written[-1])
    monkeypatch.setattr(rounds, "BLOCK", 3)
    inside = [(c, at, rnd.choice([*range(12), None])) for c in range(8) for at in rnd.sample(range(99), rnd.choice([0, 2, 6]))]
    roots = [(e, 7 - e) for e in range(8)]
    held = spark.createDataFrame(inside, "content long, at long, x long")
    out = rounds.grow(spark.createDataFrame(roots, "entry long, content long"), held, "content", "at", "x", 3)
    want, level = [(e, None, c, None, 0) for e, c in roots], roots
    for k in (1, 2, 3):
        found = sorted((e, at, x) for e, c in level for d, at, x in inside if c == d)
        new = [(len(want) + i, e, x, at, k) for i, (e, at, x) in enumerate(found)]
        want, level = want + new, [(r[0], r[2]) for r in new]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert max(w.count() for w in written) < sum(r[4] == 3 for r in want)


def test_pieces_are_laid_out_once(spark):
    lines = spark.range(40).select((F.col("id") % 5).alias("s"), F.col("id").alias("k"), (F.col("id") * 100).alias("off"), F.lit(7).cast("long").alias("n"))
    wanted = spark.createDataFrame([(0, 3, 20), (4, 50, 70), (9, 0, 5), (None, 0, 5), (1, 5, 5)], "s long, a int, b int")
    out = pieces.slices(lines, wanted, "s", "k", "off", "n", "a", "b")
    assert "Window" not in plan_of(out)
    got = sorted(tuple(r) for r in out.select("s", F.coalesce("k", F.lit(-1)), "to", F.coalesce("off", F.lit(-1)), "size").collect())
    assert got == [(0, 0, 0, 3, 4), (0, 5, 4, 500, 7), (0, 10, 11, 1000, 6), (4, -1, 6, -1, 14), (4, 39, 0, 3901, 6), (9, -1, 0, -1, 5)]
