import numpy as np
import pytest
from granary.llm import jaccard_join as jj

from .conftest import corpus


def shingles(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, num=75, den=100):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), None if i is None else find(i)) for i, s in sets if i is not None)


def got(df):
    return sorted(tuple(r) for r in df.filter("doc_id is not null").select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("seed,longest,num", [(1, 40, 75), (2, 8, 75), (3, 150, 75), (4, 60, 50)])
def test_against_brute_force(spark, seed, longest, num):
    rows = corpus(seed, 150, vocabulary=30, longest=longest, copies=0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jj.JaccardJoin(df, num=num).components()) == brute(rows, num)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = jj.op1_jaccard_join(awkward)
    assert out.count() == len(rows)
    assert got(out) == sorted((i, n, c) for i, n, c in brute(rows))
    assert [tuple(r) for r in out.filter("doc_id is null").orderBy("n_shingles").collect()] == [(None, 0, None), (None, 116, None)]
    assert jj.op1_jaccard_join(empty).count() == 0


def test_probes_always_meet_a_similar_set():
    """Pigeonhole: some probed signature of the larger set is indexed by every similar set."""
    rnd = np.random.default_rng(0)
    bands = jj.Bands(75, 100)
    none = np.zeros(0, dtype=np.uint64)
    often = np.sort(rnd.integers(0, 1 << 63, 5_000, dtype=np.uint64))
    for size in [1, 2, 3, 4, 7, 12, 15, 16, 17, 28, 29, 60, 200, 700, 2_500]:
        for _ in range(12):
            a = np.unique(np.r_[rnd.choice(often, size // 2), rnd.integers(0, 1 << 63, size - size // 2, dtype=np.uint64)])
            drop, add = rnd.integers(0, max(1, len(a) // 8) + 1, 2)
            b = np.unique(np.r_[rnd.permutation(a)[drop:], rnd.integers(0, 1 << 63, add, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            for frequent in (none, often):
                big, small_ = (a, b) if len(a) >= len(b) else (b, a)
                h, r, ok = jj.signatures(big, bands, frequent)
                k, s, _ = jj.signatures(small_, bands, frequent)
                assert ok
                plain = set(h[np.isin(r, (jj.BOTH, jj.WIDE, jj.LESS_PROBE))].tolist()) & set(k[np.isin(s, (jj.BOTH, jj.WIDE, jj.INDEX))].tolist())
                less = set(h[r == jj.WIDE].tolist()) & set(k[s == jj.LESS_INDEX].tolist())
                assert plain or less, (len(a), len(b), both)


def test_a_set_that_cannot_be_served_is_signed_again(spark, monkeypatch):
    """With probes refused under the first seed, the next seed finds the links."""
    rows = corpus(9, 40, vocabulary=20, longest=20, copies=0.7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    join = jj.JaccardJoin(df)
    seeds = []
    plain = join._signed

    def signed(often, seed):
        seeds.append(seed)
        found = plain(often, seed)
        return found.filter("false").union(spark.createDataFrame([(1, None, None)], found.schema)) if seed == 0 else found

    monkeypatch.setattr(join, "_signed", signed)
    assert got(join.components()) == brute(rows)
    assert seeds == [0, 1]


def test_large_bucket_that_is_no_component_is_settled(spark):
    """Many texts share a passage without being similar; some pairs of them are."""
    rnd = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(60):
        own = [f"o{i // 2}x{k}" for k in range(30)]
        if i % 2:
            own[int(rnd.integers(30))] = "edit"
        rows.append((i, " ".join(shared + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jj.JaccardJoin(df).components()) == brute(rows)


def test_bucket_whose_links_are_all_away_from_its_star(spark, monkeypatch):
    """Links within a bucket that don't touch its least document are found by settling it."""
    rows, found = [], []
    shared = " ".join(f"s{i}" for i in range(12))
    for k in range(8):
        base = [f"o{k}x{i}" for i in range(60)]
        rows += [(10 * k, shared + " " + " ".join(base)), (10 * k + 1, shared + " " + " ".join([*base[:-3], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = jj.JaccardJoin(df)
    one = [{"m": i, "s": 2 * 48 + 1} for i, _ in rows]
    monkeypatch.setattr(join, "_signed", lambda often, seed: spark.createDataFrame([(0, 77, one)], "a long, b long, members array<struct<m: long, s: int>>"))
    assert got(join.components()) == brute(rows)


def test_low_thresholds_end_and_are_exact(spark):
    rows = corpus(6, 60, vocabulary=15, longest=30, copies=0.7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(jj.JaccardJoin(df, num=25).components()) == brute(rows, 25)


def test_parities_never_rule_out_a_similar_pair():
    """Two sets differ in at least as many shingles as their parities differ in bits."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.r_[rnd.permutation(a)[int(rnd.integers(0, len(a))) :], rnd.integers(0, 1 << 63, int(rnd.integers(0, 60)), dtype=np.uint64)])
        bits = int(np.unpackbits((jj._parity(a) ^ jj._parity(b)).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b))
    assert not jj._parity(a[:0]).any()


def test_open_buckets_of_the_same_documents_are_merged(spark):
    """Parts of one group become one bucket; parts that only share their least document stay; every pair keeps a bucket and a probe."""
    group = [[m for m in range(24) if m == 0 or (m * 7 + b) % 5] for b in range(30)]
    apart = [[100, *range(1_000 * b + 200, 1_000 * b + 203)] for b in range(20)]
    rows = [(b, m, 2 * 9 + (m + b) % 2, m) for b, ms in enumerate(group + apart) for m in ms]
    op = jj.JaccardJoin(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    got = op._merged(spark.createDataFrame(rows, "bucket long, m long, s int, component long")).collect()
    op.close()

    def pairs(rows):
        by = {}
        for b, m, s, _ in rows:
            by.setdefault(b, []).append((m, s % 2))
        return [(min(a, m), max(a, m)) for ms in by.values() for a, p in ms if p for m, _ in ms if a != m]

    assert set(pairs(rows)) <= set(pairs(got))
    assert len(pairs(got)) * 8 < len(pairs(rows)) and len({r.bucket for r in got}) == 1 + len(apart)
    assert {r.m for r in got if r.bucket == 0} == set(range(24)) and all(r.component == r.m for r in got)


def test_sets_are_never_written(spark, monkeypatch):
    """No table between steps holds the sets, and ids of several rows still have theirs."""
    rows = corpus(6, 120, vocabulary=30, longest=60, copies=0.6)
    rows += [(i, t + " more") for i, t in rows[:20]] + rows[20:30]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kinds, plain = [], jj.cut
    monkeypatch.setattr(jj, "cut", lambda d, what: kinds.extend(d.dtypes) or plain(d, what))
    assert set(got(jj.JaccardJoin(df).components())) == set(brute(rows))
    assert kinds and "array<bigint>" not in {kind for _, kind in kinds}


def test_longer_parities_rule_out_large_sets(spark, monkeypatch):
    """Large sets that share a passage, but too little to link, aren't moved whole."""
    words = lambda k, n: [f"{k}x{i}" for i in range(n)]
    shared = words("s", 2200)
    rows = [(i, " ".join(shared + words(f"o{i}", 1200))) for i in range(6)] + [(9, " ".join(shared + words("o1", 1150)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, plain = {}, jj.cut

    def cut(d, what):
        out = plain(d, what)
        if what in ("alike", "closer", "links"):
            counts[what] = counts.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(jj, "cut", cut)
    assert got(jj.JaccardJoin(df).components()) == brute(rows)
    assert counts["links"] == counts["closer"] < counts["alike"]
