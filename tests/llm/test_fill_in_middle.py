import hashlib
import re

import pytest
from granary.llm import fill_in_middle as fm
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)


TEXTS = [
    "one", " one  two\t\nthree ", "\x0b\x0c\r", "é ñ  日本語 😀 z", "a < <b <S c <<S> d", "x <P> y", "<M>", "S> a <P", "no break wide \x85 x", "\x00 a\x1c b", None, "",
]


def test_against_brute_force(spark):
    rows = [(i * 5 - 40, TEXTS[i % len(TEXTS)]) for i in range(240)] + [(None, TEXTS[1]), (None, None)] + [(7, TEXTS[3])] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fm.fill_in_middle(df)
    want = sorted((brute(*r) for r in rows), key=str)
    assert got(out) == want and {"plain", "psm", "spm"} == {w[2] for w in want}
    back = out.filter(F.coalesce("text", F.lit("")) != fm.restored(F.col("output"), F.col("form")))
    assert back.count() == 0


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    clash = awkward.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("output", F.lit(2))
    out = fm.fill_in_middle(clash)
    assert got(out) == sorted((brute(*r) for r in rows), key=str)
    assert out.columns == [*awkward.columns, *fm.ADDED.names]
    assert fm.op11_fill_in_middle(empty).count() == 0
    for r in fm.op11_fill_in_middle(awkward).collect():
        assert len(r.output_sha256) == len(r.restored_sha256) == 64
    assert "Exchange" not in fm.fill_in_middle(awkward)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 8, 1 << 15])
def test_slices_end_where_units_end(monkeypatch, size):
    monkeypatch.setattr(fm, "SLICE", size)
    split = Split(Regex(fm.UNIT), behavior="isolated")
    for text in [t for t in TEXTS if t] + [" " * 50 + "a" + " " * 50, "b" * 60 + " c", "ab cd  ef" * 9]:
        units = UNIT.findall(text)
        assert "".join(p for _, p in fm.slices(text)) == text
        ends = [len("".join(units[:k])) for k in range(len(units) + 1)]
        for a in range(len(units) + 1):
            for b in range(a, len(units) + 1):
                assert fm.unit_ends(text, split, (a, b)) == (len(units), [ends[a], ends[b]])


def test_long_runs():
    split = Split(Regex(fm.UNIT), behavior="isolated")
    for text, n in ((" " * 2_000_000, 1), ("a" + "\n" * 2_000_000, 2), ("a" * 2_000_000, 1), (" " * 2_000_000 + "é", 1), ("x y " * 300_000, 600_001)):
        assert fm.unit_ends(text, split)[0] == n
