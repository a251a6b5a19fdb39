import pytest
from granary.llm import substring_dedup as sd

from .conftest import corpus


def brute(rows, window):
    words = [(i, [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


@pytest.mark.parametrize("seed,window,gram,batches", [(1, 5, 2, 1), (2, 5, 5, 2), (3, 9, 3, 4), (4, 12, 10, 3)])
def test_against_brute_force(spark, seed, window, gram, batches):
    rows = corpus(seed, 120, vocabulary=12, longest=50, copies=0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(sd.deduplicate_substrings(df, batches, window, gram)) == brute(rows, window)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(sd.deduplicate_substrings(awkward)) == brute(rows, 50)
    assert sd.op3_substring_dedup(empty).count() == 0


def test_index_grows_compacts_and_opens_again(spark, tmp_path):
    rows = corpus(8, 90, vocabulary=10, longest=40, copies=0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [df.filter(f"doc_id > {a} and doc_id <= {b}") for a, b in ((0, 60), (60, 130), (130, 200), (200, 999))]
    out, before = [], None
    for p in parts:
        index = sd.FingerprintIndex(spark, f"file://{tmp_path}/index", window=6, gram=3, fanout=2)
        out += got(index.deduplicate(p, before))
        before = p if before is None else before.unionByName(p)
    assert sorted(out, key=str) == brute(rows, 6)
    assert [level for level, _ in index.runs] == [2]


def test_history_is_merged_where_it_lies(spark, tmp_path):
    """The join of a batch with a run reads buckets and exchanges neither side."""
    rows = corpus(8, 90, vocabulary=10, longest=40, copies=0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = sd.FingerprintIndex(spark, f"file://{tmp_path}/index", window=6, gram=3, buckets=4)
    for a, b in ((0, 90), (90, 180)):
        index.deduplicate(df.filter(f"doc_id > {a} and doc_id <= {b}"), df.filter(f"doc_id <= {a}"))
    old, new = (path for _, path in index.runs)
    found = index.known(index._read(new), old)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # the plan that ran
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_postings_that_an_earlier_document_has_are_left_out(spark):
    """A passage that many documents have keeps the postings of the first."""
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(i, f"{shared} own{i} " + " ".join(f"o{i}x{k}" for k in range(9))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = sd.FingerprintIndex(spark, window=8, gram=4)
    out = []
    for a, b in ((-1, 9), (9, 19), (19, 29)):
        out += got(index.deduplicate(df.filter(f"doc_id > {a} and doc_id <= {b}"), df.filter(f"doc_id <= {a}") if a > 0 else None))
    assert sorted(out, key=str) == brute(rows, 8)
    hot = index.postings().groupBy("fp").count()
    assert hot.agg({"count": "max"}).first()[0] == 1
    edges = index.windows().groupBy("w").count()
    assert edges.agg({"count": "max"}).first()[0] == 1 and edges.count() >= 20
    path = index.path.removeprefix("file:")
    index.remove()
    import os

    assert not os.path.exists(path)


def test_texts_of_history_are_read_once_for_a_passage(spark, monkeypatch):
    """However many documents have a passage, a later batch reads the text of the first for it."""
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, " ".join(f"o{i}x{k}" for k in range(9)) + f" {shared} own{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, read = sd.FingerprintIndex(spark, window=8, gram=4), []
    plain = sd.FingerprintIndex._windows_of
    monkeypatch.setattr(sd.FingerprintIndex, "_windows_of", lambda self, d, p: read.append(p.select("doc_id").distinct().count()) or plain(self, d, p))
    index.deduplicate(df.filter("doc_id < 40")).collect()
    read.clear()
    out = index.deduplicate(df.filter("doc_id >= 40"), df.filter("doc_id < 40")).collect()
    assert read == [20, 1] and {r.n_removed for r in out} == {60}
    index.remove()


def test_batches_in_any_order(spark):
    """A later batch with smaller ids is covered by nothing after it, and covers later ones."""
    rows = corpus(9, 90, vocabulary=10, longest=40, copies=0.6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = sd.FingerprintIndex(spark, window=6, gram=3)
    index.deduplicate(df.filter("doc_id > 100 and doc_id <= 180"))
    index.deduplicate(df.filter("doc_id <= 100"), df.filter("doc_id > 100 and doc_id <= 180"))
    out = got(index.deduplicate(df.filter("doc_id > 180"), df.filter("doc_id <= 180")))
    assert out == [r for r in brute(rows, 6) if r[0] > 180]
    index.remove()


def test_equal_windows_under_a_fingerprint_are_compared_at_once(spark, monkeypatch):
    """Copies deal no windows, and of near copies one of each kind deals those under its fingerprints."""
    base = [f"s{k}" for k in range(80)]
    near = [*base[:40], "other", *base[41:]]
    rows = [(i, " ".join(near if i % 3 == 2 else base)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []
    plain = sd.FingerprintIndex._bucketed
    monkeypatch.setattr(
        sd.FingerprintIndex, "_bucketed", lambda self, r, path, **k: ("/met-" in path and dealt.append(r.count())) or plain(self, r, path, **k)
    )
    index = sd.FingerprintIndex(spark, window=8, gram=4)
    copies = df.filter("doc_id % 3 <> 2")
    out = got(index.deduplicate(copies.filter("doc_id < 20"))) + got(index.deduplicate(copies.filter("doc_id >= 20"), copies.filter("doc_id < 20")))
    assert sorted(out, key=str) == brute([r for r in rows if r[0] % 3 != 2], 8) and dealt == [0, 0]
    index.remove()
    dealt.clear()
    assert got(sd.deduplicate_substrings(df, 2, 8, 4)) == brute(rows, 8)
    assert all(n < 40 for n in dealt)
