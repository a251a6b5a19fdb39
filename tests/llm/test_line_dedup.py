import pytest
from granary.llm import line_dedup as ld
from pyspark.sql import functions as F

from .conftest import corpus


def brute(rows, k):
    """rows with distinct ids."""
    first, seqs = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        lines = t.split("\n")
        seqs[i] = [n for n, x in enumerate(lines) if x.strip(" \t\r\f\x0b")]
        for j in range(len(seqs[i]) - k + 1):
            first.setdefault(tuple(lines[n] for n in seqs[i][j : j + k]), (i, j))
    out = []
    for i, t in rows:
        gone, lines = set(), t.split("\n") if t is not None else []
        for j in range(len(seqs.get(i, ())) - k + 1):
            ns = seqs[i][j : j + k]
            if first[tuple(lines[n] for n in ns)] != (i, j):
                gone |= set(ns)
        out.append((i, len(lines), len(gone), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 2), (3, 3), (4, 5)])
def test_against_brute_force(spark, seed, k):
    rows = corpus(seed, 60, vocabulary=9, longest=25, copies=0.5, line="\n")
    rows = [(i, t.replace("\na1\n", "\n \n")) for i, t in rows] + [(500, None), (501, ""), (502, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ld.deduplicate_lines(df, k)) == brute(rows, k)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.filter("doc_id <> 6").collect()]
    out = ld.deduplicate_lines(awkward)
    assert got(out.filter("doc_id <> 6")) == brute(rows, 1)
    assert out.filter("doc_id is null").agg(F.sum("n_removed")).first()[0] == 0
    # copies of document 1 in one line, fifty of them, and another text of their id
    assert {tuple(r) for r in out.filter("doc_id = 6").groupBy("n_removed").count().collect()} == {(1, 50), (0, 1)}
    assert set(awkward.columns) <= set(out.columns) and out.count() == awkward.count()
    assert ld.op7_line_dedup(empty).count() == 0


def test_ranks_are_in_the_order_of_the_suffixes(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\na\nb\nd"), (2, "a\nb\nc\na\nb")], "doc_id long, text string")
    h = {r.line: r.h for r in ld.line_table(df).withColumn("h", F.xxhash64("line")).collect()}
    rows = ld.suffix_ranks(df, 3).collect()
    text = {1: "abcabd", 2: "abcab"}
    keyed = sorted((r["rank"], [h[c] for c in text[r.doc_id][r.i : r.i + 3]]) for r in rows)
    assert [k for _, k in keyed] == sorted(k for _, k in keyed)
    assert {(r.doc_id, r.i) for r in rows} == {(d, i) for d in (1, 2) for i in (0, 1, 2)}


def test_plan_has_no_python(spark, awkward):
    plan = ld.op7_line_dedup(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_runs_are_maximal_and_their_lengths_exact(spark):
    """Every run is one of the source, too, line for line, can't be longer, and no run lies inside another."""
    rows = corpus(7, 60, vocabulary=7, longest=40, copies=0.6, line="\n") + [(600, "\n".join(["same"] * 37)), (601, "\n".join(["same"] * 12))]
    long_ = "\n".join(f"line {k}" for k in range(75))
    rows += [(700, "first\n" + long_ + "\nend"), (701, long_ + "\nother"), (702, "x\n" + long_)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {i: [x for x in t.split("\n") if x.strip()] for i, t in rows}
    runs = ld.repeated_runs(df, 2).collect()
    seen = {}
    for r in runs:
        mine, other = text[r.doc_id][r.i :], text[r.source.doc_id][r.source.i :]
        common = next((k for k, (a, b) in enumerate(zip(mine, other)) if a != b), min(len(mine), len(other)))
        assert common == r.n >= 2 and (r.source.doc_id, r.source.i) < (r.doc_id, r.i)
        seen.setdefault(r.doc_id, []).append((r.i, r.i + r.n))
    for spans in seen.values():
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)
    assert {(r.doc_id, r.i, r.n, r.source.doc_id, r.source.i) for r in runs} >= {(701, 0, 75, 700, 1), (702, 1, 75, 700, 1), (601, 0, 12, 600, 0), (600, 1, 36, 600, 0)}
    assert got(ld.deduplicate_lines(df, 2)) == brute(rows, 2)
    shown = {r.doc_id: r.runs for r in ld.deduplicate_lines(df, 2).collect()}
    assert [tuple(x) for x in shown[702]] == [(1, 75, 700, 1)]


def test_levels_double_until_no_suffix_is_repeated(spark):
    text = "\n".join(f"l{k}" for k in range(20))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    levels = ld.suffix_levels(df, 3)
    assert [d for d, _ in levels] == [1, 2, 3, 6, 12]
    assert [level.count() for _, level in levels] == [40, 38, 36, 30, 18]


@pytest.mark.parametrize("least", [1, 2])
def test_repeated_rows_are_one_document(spark, least):
    """Fifty times two rows: no place is carried on more than once, and each row loses what the first of its kind does."""
    lines = [f"line {k}" for k in range(7)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own", *lines[2:]]))]
    df = spark.createDataFrame(rows * 50 + [(3, "\n".join(lines))], "doc_id long, text string")
    runs = ld.repeated_runs(df, least)
    assert sorted((r.doc_id, r.i, r.n) for r in runs.collect()) == [(2, 1, 5), (3, 0, 7)]
    assert all(level.count() == level.select("doc_id", "part", "i").distinct().count() for _, level in ld.suffix_levels(df, least))
    out = {(r.doc_id, r.n_removed, r["count"]) for r in ld.deduplicate_lines(df, least).groupBy("doc_id", "n_removed").count().collect()}
    assert out == {(1, 0, 50), (2, 5, 50), (3, 7, 1)}


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of three values every line meets others: ranks come from the texts."""
    monkeypatch.setattr(ld, "_hash", lambda line: F.length(line) % 3)
    rows = corpus(11, 40, vocabulary=9, longest=20, copies=0.5, line="\n") + [(900, "aa\nbb\ncc"), (901, "cc\naa\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (1, 2):
        assert got(ld.deduplicate_lines(df, k)) == brute(rows, k)
