import numpy as np
import pyarrow as pa
import pytest
from granary.llm import quality, toxicity
from granary.llm import textkernel as tk
from granary.llm.common import table

SF = "/root/testdata/sf0.01"


def ranked(scores, y):
    order = np.argsort(np.argsort(scores))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("op,label,least", [(quality.op9_quality, "quality", 0.95), (toxicity.op5_toxicity, "toxic", 0.8)])
def test_held_out(spark, op, label, least):
    out = op(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = out.join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert ranked(rows.score.to_numpy(), rows[label].to_numpy()) >= least
    assert (rows.predicted == rows[label]).mean() > 0.9
    assert out.count() == table(spark, SF, "documents").count()


@pytest.mark.parametrize("op,label", [(quality.op9_quality, "quality"), (toxicity.op5_toxicity, "toxic")])
def test_awkward_rows(spark, awkward, empty, op, label):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (8, 7), (1, 1), (15, 1)], f"doc_id long, {label} int")
    for docs, marks in ((awkward, labels), (awkward, labels.limit(0)), (empty, labels)):
        rows = op(docs, marks).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    from granary.llm.common import crc_split
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(crc_split(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables + a.grids, b.tables + b.grids))


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3_000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel.fit(x, y)
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert len(set(quality.AdditiveModel.fit(x[:0], y[:0]).score(x).tolist())) == 1


def test_clauses():
    I, T, N, R, O = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER
    run = lambda *s: toxicity.run_clause(list(s), [1.0] * len(s))
    assert run(O, O) == 0
    assert run(T, O, I) > run(O, I) > run(N, O, I) > 0
    assert run(O, I) > run(R, T, O, I) > 0
    assert run(N, O, O, O, O, I) == run(I)
    m = toxicity.Grammar.seeded().freeze()
    block = next(tk.blocks(pa.array(["You are an idiot.", "He said you are an idiot.", "You are not an idiot.", "nothing here", None]), tk.ALNUM, True))
    w = m.measures(block)[:, 0]
    assert w[0] > w[1] > 0 and w[0] > w[2] > 0 and w[3] == w[4] == 0


def _features_by_hand(text):
    """The numbers of a text by plain loops over its bytes and words."""
    raw = (text or "").encode()
    words = [w for w in __import__("re").split(rb"[ \t-\r]+", raw) if w]
    n, marks = max(len(words), 1), set(quality._MARKS)
    is_ = {"upper": lambda c: 65 <= c <= 90, "lower": lambda c: 97 <= c <= 122, "high": lambda c: c >= 128}
    letters = [sum(is_["upper"](c) or is_["lower"](c) or is_["high"](c) for c in w) for w in words]
    uppers = [sum(map(is_["upper"], w)) for w in words]
    share = lambda f: sum(map(f, raw)) / max(len(raw), 1)
    count = [words.count(w) for w in set(words)]
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) <= 3 for w in words) / n,
        share(is_["upper"]), share(lambda c: 48 <= c <= 57), share(is_["high"]), share(lambda c: c in marks), share(lambda c: c == 32), share(lambda c: c == 10),
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n, len(count) / n if words else 0, max(count, default=0) / n,
        sum(k == 0 for k in letters) / n, sum(sum(c in marks for c in w) >= 2 for w in words) / n, sum(u > 1 and u >= k for u, k in zip(uppers, letters)) / n,
        *(share(lambda c, m=m: c == m) for m in b"!?.,|*#&$%@"),
    ]


def test_features_against_loops():
    rnd = __import__("random").Random(2)
    pieces = ["word", "WORD", "Aa", "é", "12", "!!", "a", " ", "\n", "\t", "x" * 14, "word", "#tag", "日本"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(120)] + ["", None, "   ", "z"]
    got = np.concatenate([quality.features(b) for b in tk.blocks(pa.array(texts), tk.SPACED, False, block=900)])
    assert np.allclose(got, np.array([_features_by_hand(t) for t in texts]))


def test_score_is_a_sum_of_looked_up_bins():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 5)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality.AdditiveModel.fit(x, y)
    for row, score in zip(x[:60], model.score(x[:60])):
        z = model.base
        bin_ = lambda edges, v: sum(e < v for e in edges)
        for f, table_ in enumerate(model.tables):
            z += table_[bin_(model.edges[f], row[f])]
        for (i, j), grid in zip(model.pairs, model.grids):
            z += grid[bin_(model.coarse[i], row[i]), bin_(model.coarse[j], row[j])]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
