import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from granary.llm import toxicity as tx


def one_after_another(symbols, weights):
    """What the five write, each reading what the one before wrote."""
    total = list(weights)
    for t in tx.transducers():
        symbols, factors = t.run(symbols)
        total = [a * b for a, b in zip(total, factors)]
    return sum(w for s, w in zip(symbols, total) if s == tx.HIT)


def test_the_composition_is_the_five_one_after_another():
    rnd = random.Random(1)
    composed = tx.transducers()[0]
    for t in tx.transducers()[1:]:
        composed = tx.compose(composed, t)
    for _ in range(3_000):
        symbols = [rnd.choice(tx.WORDS) for _ in range(rnd.randint(0, 14))]
        weights = [rnd.random() for _ in symbols]
        want = one_after_another(symbols, weights)
        written, factors = composed.run(symbols)
        assert sum(f * w for s, f, w in zip(written, factors, weights) if s == tx.HIT) == pytest.approx(want)
        assert tx.run_clause(symbols, weights) == pytest.approx(want)


def test_each_transducer():
    o, i, h, t, n, r, x = (tx.OTHER, tx.INSULT, tx.THREAT, tx.TARGET, tx.NEGATION, tx.REPORT, tx.INTENSE)
    assert tx.insult_transducer().run([x, i, i]) == ([x, tx.HIT, tx.HIT], [1, tx.INTENSIFIED, 1])
    assert tx.threat_transducer().run([h, o, t, t]) == ([o, o, tx.HIT_TARGET, t], [1, 1, tx.THREATENING, 1])
    assert tx.threat_transducer().run([h, o, o, o, t])[0] == [o, o, o, o, t]
    assert tx.target_transducer().run([tx.HIT, t])[1] == [tx.TARGETED, 1]
    assert tx.target_transducer().run([tx.HIT, o])[1] == [1, 1]
    assert tx.negation_transducer().run([n, o, o, tx.HIT, tx.HIT])[1] == [1, 1, 1, tx.NEGATED, 1]
    assert tx.report_transducer().run([tx.HIT, r, o, tx.HIT])[1] == [1, 1, 1, tx.REPORTED]


def weights(*texts):
    block = next(tx.word_blocks(pa.array(texts)))
    return np.expm1(tx.Grammar.seeded().freeze().measures(block)[:, 0]).tolist()


def test_clauses_of_texts():
    plain, not_, arent, curly, said, kill, process, upper, none, null = weights(
        "You are stupid.", "You are not stupid.", "You aren't stupid.", "You aren\u2019t stupid", "He said you are stupid.", "I will kill you",
        "kill the process", "TU ES UN CR\u00c9TIN\u2026", "nothing here", None,
    )
    assert plain == pytest.approx(tx.TARGETED)
    assert not_ == arent == curly == pytest.approx(tx.TARGETED * tx.NEGATED)
    assert said == pytest.approx(tx.TARGETED * tx.REPORTED)
    assert kill == pytest.approx(tx.THREATENING * tx.TARGETED) and process == none == null == 0
    assert upper == pytest.approx(tx.TARGETED)


def test_measures_against_a_plain_reading():
    """Words, clauses and sums by plain Python over random texts."""
    rnd = random.Random(4)
    words = ["you", "idiot", "Stupid", "isn't", "said", "such", "kill", "them", "word", "\u00e9t\u00e9", "'quoted'", "Cr\u00e9tin", "a1"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ". ", ", ", "\n", "\u2014", "! "]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    symbol = {w: s for s, line in reversed(tx.SEEDS.items()) for w in line.split()}
    matcher = tx.Grammar.seeded().freeze()
    got = np.concatenate([matcher.measures(b) for b in tx.word_blocks(pa.array(texts))])
    for t, row in zip(texts, got):
        total = most = clauses = n = 0
        entries = set()
        for clause in re.split(r"[.!?;:\n]", t.lower()):
            found = re.findall(r"[^\W_]+(?:'[^\W_]+)*", clause)
            n += len(found)
            score = one_after_another([symbol.get(w, tx.OTHER) for w in found], [1.0] * len(found))
            total, most, clauses = total + score, max(most, score), clauses + (score > 0)
            if score:
                entries |= {w for w in found if symbol.get(w) in (tx.INSULT, tx.THREAT)}
        want = [math.log1p(v) for v in (total, most, clauses, 100 * total / max(n, 1), len(entries))]
        assert row.tolist() == pytest.approx(want)


def test_score_is_the_curve_of_the_measures():
    grammar = tx.Grammar.seeded()
    grammar.curve = np.array([-1.0, 0.5, 0.25, -0.5, 0.125, 2.0])
    matcher = grammar.freeze()
    block = next(tx.word_blocks(pa.array(["you idiot", "fine", ""])))
    want = [1 / (1 + math.exp(1.0 - sum(a * b for a, b in zip(row, grammar.curve[1:])))) for row in matcher.measures(block).tolist()]
    assert matcher.score(block).tolist() == pytest.approx(want)
