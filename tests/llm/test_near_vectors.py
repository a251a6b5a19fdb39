import numpy as np
import pytest
from granary.llm import near_vectors as nv


def brute(rows, least=0.95):
    good = {}
    for k, (i, e) in enumerate(rows):
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, dtype=np.float64)
            good[k] = v / np.linalg.norm(v)
    near = {k: [j for j in good if j != k and len(good[j]) == len(v) and good[j] @ v >= least] for k, v in good.items()}
    label = {k: rows[k][0] for k in good}
    changed = True
    while changed:
        changed = False
        for k, js in near.items():
            m = min([label[k], *(label[j] for j in js)])
            changed |= m != label[k]
            label[k] = m
    return sorted(((i, len(near.get(k, ())), label.get(k, i)) for k, (i, e) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id").collect()), key=str)


def vectors(seed, n, d=16):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)).astype(np.float32)
    for i in range(n // 2, n):
        x[i] = x[rnd.integers(n // 2)] + rnd.normal(size=d).astype(np.float32) * rnd.choice([0, 0.01, 0.2])
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nv, "CLUSTER_ROWS", 60)
    for seed, unit_rows in ((1, 4096), (2, 40)):
        rows = vectors(seed, 300)
        join = nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), unit_rows=unit_rows)
        assert got(join.result()) == brute(rows)
        assert join.audited >= 0.9


def test_one_large_group(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=16)
    rows = [(i, (base + rnd.normal(size=16) * 0.02).astype(np.float32).tolist()) for i in range(250)] + vectors(5, 60)[:30]
    rows = [(k, e) for k, (_, e) in enumerate(rows)]
    assert got(nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), unit_rows=64).result()) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]),
        (9, [2.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.01, 0.0]), (12, [-1.0, 0.0]), (8, [1.0, 0.0]), (13, [3.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, vid long, weight int, v string")
    out = nv.op10_near_vectors(df)
    assert got(out) == brute(rows)
    assert {r.vec_id: r.kept for r in out.collect()}[9] is False
    assert nv.op10_near_vectors(df.limit(0)).count() == 0


def _sparse():
    """700 unlinked vectors and two pairs of near copies."""
    x = np.random.default_rng(6).normal(size=(700, 32))
    return [(i, v.tolist()) for i, v in enumerate(np.r_[x, x[[30, 400]] * 1.5 + 0.01])], lambda vids: []


def _one_large_group():
    """A group of 150 vectors, 20 pairs."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(21, 32))
    x = np.r_[x[:1] + rnd.normal(size=(150, 32)) * 0.01, x[1:], x[1:] + 0.01]
    return [(i, v.tolist()) for i, v in enumerate(x)], lambda vids: [i for i in vids if i < 150]


@pytest.mark.parametrize("case,gathered,tries", [(_sparse, 0, 5), (_one_large_group, 16, 1)])
def test_lost_links_are_seen_and_not_accepted(spark, monkeypatch, case, gathered, tries):
    """Brute force follows the last beam, or the first that it costs less than the next."""
    monkeypatch.setattr(nv, "GATHERED", gathered)
    rows, kept = case()
    tried = []

    def lossy(self, vertices, n, overlap, beam):
        tried.append(beam)
        least = {r.vid: r.least for r in vertices.select("vid", "least").collect()}
        large = [v for v, i in least.items() if i in kept(least.values())]
        out = [(v, len(large) - 1, len(large) - 1, min(large)) if v in large else (v, 0, 0, v) for v in least]
        return spark.createDataFrame(out, "vid long, links long, pairs long, root long")

    monkeypatch.setattr(nv.NearVectors, "_links", lossy)
    join = nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got(join.result()) == brute(rows)
    assert tried == [nv.BEAM << k for k in range(tries)] and join.audited == 1.0


def test_audit_stops_at_enough_groups(spark, monkeypatch):
    monkeypatch.setattr(nv, "AUDITED", 16)
    monkeypatch.setattr(nv, "AUDITED_GROUPS", 5)
    blocks = []
    cut_up = nv.NearVectors._blocks

    def counted(self, *args):
        for ids, x in cut_up(self, *args):
            blocks.append(len(ids))
            yield ids, x

    monkeypatch.setattr(nv.NearVectors, "_blocks", counted)
    rows = vectors(8, 300)
    assert got(nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).result()) == brute(rows)
    assert 0 < sum(blocks) < 250


def planted(seed, n, groups, d=24):
    """n spread vectors and ``groups`` groups of 2 to 40 near copies around new centres."""
    rnd = np.random.default_rng(seed)
    x = [rnd.normal(size=(n, d))]
    for _ in range(groups):
        size = int(rnd.choice([2, 3, 5, 12, 40]))
        x.append(rnd.normal(size=(1, d)) + rnd.normal(size=(size, d)) * rnd.choice([0.02, 0.12]))
    x = np.concatenate(x)[rnd.permutation(n + sum(len(g) for g in x[1:]))]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("clusters", [1_024, 4])
def test_planted_groups_over_many_clusters(spark, monkeypatch, clusters):
    """The graph search alone, without the exact pass, over one and two levels of clusters: thousands of pairs."""
    monkeypatch.setattr(nv, "CLUSTER_ROWS", 250)
    monkeypatch.setattr(nv, "CLUSTERS", clusters)
    rows = planted(11, 2_000, 120)
    x = np.array([e for _, e in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 4_000
    join = nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    tried = []
    links = join._links
    monkeypatch.setattr(join, "_links", lambda r, n, o, b: tried.append(links(r, n, o, b)) or tried[-1])
    got_ = {r.vec_id: r for r in join.result().collect()}
    assert len(tried) == 1 and 0.9 <= join.audited <= join.planted <= 1
    assert tried[0].filter("vid < 0").count() == 0
    assert all(r.recall == join.audited for r in got_.values())
    n_links = np.array([got_[i].n_links for i in range(len(rows))])
    assert (n_links <= near.sum(axis=1)).all() and n_links.sum() >= 0.98 * near.sum()


def test_large_and_small_components_do_not_overflow(spark):
    rows = [(1, [1e200, 1e200]), (2, [3e-200, 3e-200]), (3, [1.0, 1.0]), (4, [1e300, -1e300])]
    out = nv.op10_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got(out) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
    assert "recall" not in out.columns


def test_units_stay_small_under_skew(spark, monkeypatch):
    """A common mean and uneven spread, as embeddings have: plain centroids draw a third of all vectors into one cluster."""
    monkeypatch.setattr(nv, "CLUSTER_ROWS", 200)
    rnd = np.random.default_rng(12)
    n, d, units = 5_000, 32, 400
    x = rnd.normal(size=d) + np.exp(rnd.normal(size=(n, 1)) * 0.8) * rnd.normal(size=(n, d)) * 0.7
    x[n - 600 :] = x[:600] + rnd.normal(size=(600, d)) * 0.02
    plain = nv.fit_centroids(nv._unit(x), n // 200)
    assert np.bincount(np.argmax(nv._unit(x) @ plain.T, axis=1)).max() > n // 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    join = nv.NearVectors(df, unit_rows=units)
    dealt = join._units(join.vertices, n, nv.OVERLAP)
    largest = dealt.groupBy("cluster", "b1", "b2", "slice").count().agg({"count": "max"}).first()[0]
    members = dealt.filter("member").select("cluster", "vid").distinct().groupBy("cluster").count().agg({"count": "max"}).first()[0]
    assert largest <= 2.5 * units and members <= 6 * 200
    u = nv._unit(x)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    tried, links = [], join._links
    monkeypatch.setattr(join, "_links", lambda r, n, o, b: tried.append(b) or links(r, n, o, b))
    got_ = {r.vec_id: r.n_links for r in join.result().collect()}
    found = np.array([got_[i] for i in range(n)])
    assert len(tried) == 1 and (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum() > 1_000


def test_audit_is_bounded(spark, monkeypatch):
    """Where links are rare it ends at so many vertices, not at the last one."""
    monkeypatch.setattr(nv, "AUDITED", 16)
    monkeypatch.setattr(nv, "AUDIT_ROWS", 100)
    blocks, cut_up = [], nv.NearVectors._blocks

    def counted(self, *args):
        for ids, x in cut_up(self, *args):
            blocks.append(len(ids))
            yield ids, x

    monkeypatch.setattr(nv.NearVectors, "_blocks", counted)
    rows, _ = _sparse()
    assert got(nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).result()) == brute(rows)
    assert 100 <= sum(blocks) < 400


def test_probes_are_at_cosines_that_link(spark):
    rows = vectors(13, 200)
    join = nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    turned = join.vertices.mapInArrow(nv._turned(0.95), "vid long, v array<double>, weight long").collect()
    own = {r.vid: nv._unit(np.array([r.v]))[0] for r in join.vertices.collect()}
    cosine = [float(np.dot(r.v, own[-1 - r.vid])) for r in turned]
    assert len(turned) == len(own) and min(cosine) >= 0.95 and max(cosine) <= 1 and np.std(cosine) > 0.005 and {r.weight for r in turned} == {0}


def test_probes_see_what_no_link_shows(spark, monkeypatch):
    """A table without links, searched by a graph that finds nothing from afar: the probes tell, and brute force follows."""
    monkeypatch.setattr(nv, "VISITS", 0)
    monkeypatch.setattr(nv, "CLUSTER_ROWS", 4)
    monkeypatch.setattr(nv, "OVERLAP", 1)
    monkeypatch.setattr(nv, "BEAM", 1)
    x = np.random.default_rng(14).normal(size=(400, 3))
    x = x[np.unique(nv._unit(x).round(1), axis=0, return_index=True)[1]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    join = nv.NearVectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.9, recall=0.999)
    seen, links = [], join._links
    monkeypatch.setattr(join, "_links", lambda *a: [links(*a), seen.append(join.planted)][0])
    assert got(join.result()) == brute(rows, 0.9)
    assert min(seen) < 0.999
