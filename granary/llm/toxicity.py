"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols: insult, threat verb, target, negation, reporting verb, intensifier,
other.  Five weighted transducers each read a clause and write it anew, with a weight for every
symbol:

* the insult transducer writes a hit for an insult, a heavier one right after an intensifier;
* the threat transducer writes a hit where a threat verb is followed within REACH words by a target;
  a threat verb without a target is nothing;
* the target transducer guesses at the start whether the clause names a target and is checked at
  the end, so that the hits before the target are raised, too;
* the negation transducer lowers hits up to REACH words after a negation;
* the reported-speech transducer lowers hits after a reporting verb, to the end of the clause.

``compose`` joins two transducers into one; the composition of all five, unfolded into a table of
states by symbols, is what reads a text's clauses.  The seed lexicon is joined by insults found in labelled rows:
words and word stems that many toxic and nearly no other documents have.  A logistic curve,
fitted on the same rows, turns the clause weights of a text into its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bound_batches, crc_split, tidy
from .quality import _rows, labelled_sample

SAMPLE_ROWS = 6_000
THRESHOLD = 0.5
STEMS = (3, 12)
#: An entry needs this many toxic documents, this share of them, and at most this share of others.
SUPPORT, SUPPORT_SHARE, OTHERS = 5, 0.01, 0.05
#: Learned entries at most, those of the largest weight (they are part of the model, which is sent to every task).
LEXICON = 4_096

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSE, HIT, HIT_TARGET = range(9)
#: Symbols of words, and all symbols that transducers read and write.
WORDS, SYMBOLS = range(7), range(9)
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile "
    "dumbass bastard bastards asshole vermin degenerate dummkopf vollidiot abschaum arschloch wichser imbécile crétin "
    "connard connasse abruti ordure salaud gilipollas imbécil cabrón escoria pendejo",
    THREAT: "kill murder strangle lynch stab behead umbringen töten erschießen tuer égorger frapper matar matarte asesinar",
    TARGET: "you your yours you're ur he she they him her them these those du dich dir dein ihr euch sie tu toi te vous il elle ils "
    "elles tú ti usted ustedes él ella ellos",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't won't nobody nicht kein keine keinen nie niemals ne pas jamais "
    "aucun nunca jamás ningún",
    REPORT: "said says say called calls wrote writes quoted quotes reported reports according allegedly sagte schrieb nannte "
    "zitierte laut dit écrit appelé selon dijo escribió llamó según",
    INTENSE: "total complete absolute utter utterly such fucking damn bloody totaler absoluter verdammter gros espèce sale "
    "puto maldito",
}
#: Factors that the transducers write, and how many words a threat and a negation reach.
INTENSIFIED, THREATENING, TARGETED, NEGATED, REPORTED, REACH = 1.2, 1.5, 1.25, 0.4, 0.5, 3
MEASURES = 5


@dataclass
class Transducer:
    """A weighted transducer that writes a symbol for each that it reads.

    ``arcs``: (state, symbol read) to the (next state, symbol written, weight) it may take; a state
    without an arc for a symbol can't read it.  Several arcs and starts are guesses; of all
    ways through a clause at most one may end in ``accepting``.
    """

    starts: list
    arcs: dict[tuple, list[tuple]]
    accepting: set

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """Symbols and weights written along the one way that is accepted."""
        ways = [(s, [], []) for s in self.starts]
        for x in symbols:
            ways = [(t, [*out, y], [*ws, w]) for s, out, ws in ways for t, y, w in self.arcs.get((s, x), ())]
        done = [(out, ws) for s, out, ws in ways if s in self.accepting]
        if len(done) != 1:
            raise ValueError("a clause must have one way through")
        return done[0]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that does what ``b`` does with what ``a`` writes; weights are multiplied.  States are
    pairs; only those that can be reached are made."""
    starts = [(p, q) for p in a.starts for q in b.starts]
    arcs, todo, seen = {}, list(starts), set(starts)
    while todo:
        p, q = state = todo.pop()
        for x in SYMBOLS:
            found = [((p2, q2), z, v * w) for p2, y, v in a.arcs.get((p, x), ()) for q2, z, w in b.arcs.get((q, y), ())]
            if found:
                arcs[state, x] = found
            for t, _, _ in found:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
    return Transducer(starts, arcs, {s for s in seen if s[0] in a.accepting and s[1] in b.accepting})


def insult_transducer() -> Transducer:
    """States: whether the last word was an intensifier."""
    arcs = {}
    for s in (False, True):
        for x in SYMBOLS:
            arcs[s, x] = [(x == INTENSE, HIT if x == INSULT else x, INTENSIFIED if s and x == INSULT else 1.0)]
    return Transducer([False], arcs, {False, True})


def threat_transducer() -> Transducer:
    """States: words for which a threat verb still waits for its target."""
    arcs = {}
    for left in range(REACH + 1):
        for x in SYMBOLS:
            if x == THREAT:
                arcs[left, x] = [(REACH, OTHER, 1.0)]
            elif x == TARGET and left:
                arcs[left, x] = [(0, HIT_TARGET, THREATENING)]
            else:
                arcs[left, x] = [(max(0, left - 1), x, 1.0)]
    return Transducer([0], arcs, set(range(REACH + 1)))


def target_transducer() -> Transducer:
    """States: "none", the guess that no target comes; "due" and "met", the guess that one does."""
    arcs = {}
    for x in SYMBOLS:
        names = x in (TARGET, HIT_TARGET)
        weight = TARGETED if x in (HIT, HIT_TARGET) else 1.0
        written = HIT if x == HIT_TARGET else x
        if not names:
            arcs["none", x] = [("none", x, 1.0)]
        arcs["due", x] = [("met" if names else "due", written, weight)]
        arcs["met", x] = [("met", written, weight)]
    return Transducer(["none", "due"], arcs, {"none", "met"})


def negation_transducer() -> Transducer:
    """States: words that the last negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        for x in SYMBOLS:
            arcs[left, x] = [(REACH if x == NEGATION else max(0, left - 1), x, NEGATED if left and x == HIT else 1.0)]
    return Transducer([0], arcs, set(range(REACH + 1)))


def report_transducer() -> Transducer:
    """States: whether a reporting verb came before."""
    arcs = {}
    for s in (False, True):
        for x in SYMBOLS:
            arcs[s, x] = [(s or x == REPORT, x, REPORTED if s and x == HIT else 1.0)]
    return Transducer([False], arcs, {False, True})


def transducers() -> list[Transducer]:
    """The five, in the order in which they read a clause."""
    return [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer()]


@cache
def machine() -> Machine:
    """The composition of the five as a table, one for each process."""
    return Machine(reduce(compose, transducers()))


class Machine:
    """A composed transducer unfolded into arrays: next state (-1: none) and weight of the hit written, by state and symbol."""

    def __init__(self, t: Transducer):
        names = {s: i for i, s in enumerate(sorted({s for s, _ in t.arcs} | {n for found in t.arcs.values() for n, _, _ in found}, key=repr))}
        self.to = [[-1] * len(WORDS) for _ in names]
        self.weight = [[0.0] * len(WORDS) for _ in names]
        for (s, x), found in t.arcs.items():
            if x in WORDS:
                ((n, y, w),) = found  # guesses are made at the start only
                self.to[names[s]][x] = names[n]
                self.weight[names[s]][x] = w if y == HIT else 0.0
        self.starts = [names[s] for s in t.starts]
        self.accepting = {names[s] for s in t.accepting}

    def read(self, symbols: list[int], weights: list[float]) -> float:
        """Sum of the hits' weights times those of the words at which they are written."""
        for state in self.starts:
            total = 0.0
            for x, w in zip(symbols, weights, strict=True):
                total += w * self.weight[state][x]
                state = self.to[state][x]
                if state < 0:
                    break
            if state in self.accepting:
                return total
        raise ValueError("a clause must have one way through")


def run_clause(symbols: list[int], weights: list[float]) -> float:
    """Weight that the composed transducers write for a clause."""
    return machine().read(symbols, weights)


def clean(column: pa.Array) -> pa.Array:
    """Texts as the lexicon, learning and scoring read them: lower case of all letters, straight apostrophes,
    and spaces for what isn't ASCII nor a letter, mark or digit."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    column = pc.replace_substring_regex(column, "[\u2019\u02bc]", "'")
    return pc.replace_substring_regex(column, r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " ")


def word_blocks(column: pa.Array) -> Iterator[tk.Block]:
    """Words of cleaned texts: letters, digits, and apostrophes between two of them."""
    return tk.blocks(clean(column), tk.ALNUM, False, inner=0x27)


def _hash(words: list[str]) -> np.ndarray:
    """Hashes of words and stems, cleaned as texts are."""
    raw, at = tk.string_buffer(clean(pa.array(words, pa.large_string())))
    return tk.span_hash(raw, at[:-1], at[1:])


@dataclass
class Grammar:
    """Lexicon: hash of a word or stem to (symbol, weight); stems by their length in bytes."""

    words: dict[int, tuple[int, float]] = field(default_factory=dict)
    stems: dict[int, dict[int, tuple[int, float]]] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(MEASURES + 1))

    @classmethod
    def seeded(cls) -> Grammar:
        self = cls()
        for symbol, words in SEEDS.items():
            for h in _hash(words.split()).tolist():
                self.words.setdefault(h, (symbol, 1.0))
        return self

    def learn(self, entries: list[tuple[str, bool, float]]) -> None:
        """Add (text, whether a stem, weight) insults; seeds of other symbols keep theirs."""
        for h, (text, stem, weight) in zip(_hash([e[0] for e in entries]).tolist(), entries, strict=True):
            where = self.stems.setdefault(len(text.encode()), {}) if stem else self.words
            if where.get(h, (INSULT,))[0] == INSULT:
                where[h] = (INSULT, weight)

    def freeze(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The composed machine over blocks of texts."""

    def __init__(self, grammar: Grammar):
        def table(entries: dict[int, tuple[int, float]]) -> tuple[np.ndarray, ...]:
            keys = np.array(sorted(entries), dtype=np.uint64)
            return keys, np.array([entries[k][0] for k in keys.tolist()], np.int8), np.array([entries[k][1] for k in keys.tolist()])

        self.words, self.curve = table(grammar.words), grammar.curve
        self.stems = [(n, *table(e)) for n, e in sorted(grammar.stems.items())]
        self.seen = [self._filter(t[-3]) for t in (self.words, *self.stems)]

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(keys >> np.uint64(48)).astype(np.int64)] = True
        return seen

    def symbols(self, b: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of every word; the longest stem wins, a whole word over stems."""
        symbol, weight = np.zeros(len(b.hash), np.int8), np.zeros(len(b.hash))
        for (n, keys, kinds, weights), seen in [*zip(self.stems, self.seen[1:], strict=True), ((0, *self.words), self.seen[0])]:
            if n:
                at = np.flatnonzero(b.end - b.start >= n)
                hashes = tk.span_hash(b.raw, b.start[at], b.start[at] + n)
            else:
                at, hashes = np.arange(len(b.hash)), b.hash
            maybe = seen[(hashes >> np.uint64(48)).astype(np.int64)]
            at, hashes = at[maybe], hashes[maybe]
            k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[k] == hashes
            symbol[at[hit]], weight[at[hit]] = kinds[k[hit]], weights[k[hit]]
        return symbol, weight

    def measures(self, b: tk.Block) -> np.ndarray:
        """Logarithms of 1 plus, for each document: matched weight, largest clause, clauses with weight, weight per
        100 words, distinct entries in such clauses."""
        symbol, weight = self.symbols(b)
        breaks = np.r_[0, np.cumsum(np.isin(b.raw, np.frombuffer(b".!?;:\n", np.uint8)))]
        out = np.zeros((b.n_docs, MEASURES))
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hits):
            return out
        clause = breaks[b.start] + b.doc_of_word()
        entries: dict[int, set[int]] = {}
        read = machine().read
        for c in np.unique(clause[hits]).tolist():
            lo, hi = np.searchsorted(clause, [c, c + 1])
            score = read(symbol[lo:hi].tolist(), weight[lo:hi].tolist())
            if not score:
                continue
            doc = int(np.searchsorted(b.at, lo, side="right")) - 1
            out[doc, 0] += score
            out[doc, 1] = max(out[doc, 1], score)
            out[doc, 2] += 1
            entries.setdefault(doc, set()).update(b.hash[lo:hi][(symbol[lo:hi] == INSULT) | (symbol[lo:hi] == THREAT)].tolist())
        for doc, found in entries.items():
            out[doc, 4] = len(found)
        out[:, 3] = 100 * out[:, 0] / np.maximum(b.words, 1)
        return np.log1p(out)

    def score(self, b: tk.Block) -> np.ndarray:
        z = self.curve[0] + self.measures(b) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y and the distinct words of letters and apostrophes of each text of a sample."""
    for batch in batches:
        words = []
        for b in word_blocks(batch.column("text")):
            text = [b.raw[s:e].tobytes().decode() for s, e in zip(b.start.tolist(), b.end.tolist(), strict=True)]
            for d in range(b.n_docs):
                words.append(sorted({w for w in text[b.at[d] : b.at[d + 1]] if not any(c.isdigit() for c in w)}))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(words, pa.list_(pa.string()))], names=["y", "w"])


def learn_entries(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Words and stems that mark toxic rows of ``sample`` (text, y), at most LEXICON, best first.

    A stem that one more letter would leave as frequent gives way to the longer one.
    """
    rows = sample.dropDuplicates(["text"]).select("text", "y").mapInArrow(tidy(_distinct_words), "y int, w array<string>")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    cuts = F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: F.when(F.length(w) > k, F.substring(w, F.lit(1), k))))))
    whole = rows.select("y", F.explode("w").alias("t"), F.lit(False).alias("stem"))
    parts = rows.select("y", F.explode(F.array_compact(cuts)).alias("t"), F.lit(True).alias("stem"))
    least = max(SUPPORT, SUPPORT_SHARE * n[1])
    count = whole.unionByName(parts).filter(F.length("t") >= STEMS[0]).groupBy("t", "stem").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    weight = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    good = count.filter((F.col("a") >= least) & (F.col("b") * n[1] <= OTHERS * F.col("a") * n[0])).withColumn("weight", weight)
    found = good.orderBy(F.desc("weight"), "t", "stem").limit(LEXICON).collect()
    much = {}
    for r in found:
        for longer in ({r.t[:-1]} if r.stem else {r.t, r.t[:-1]}):
            much[longer] = max(much.get(longer, 0), r.a)
    return [(r.t, r.stem, r.weight) for r in found if not r.stem or much.get(r.t, 0) < 0.95 * r.a]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic curve by Newton's method, with a small penalty."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * len(x) / 100 * np.eye(len(w)), x.T @ (p - y) + ridge * len(x) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Grammar with learned entries and curve, from at most ``sample_rows`` labelled rows.

    Labels with a null id or other than 0 and 1, and null texts, teach nothing; rows that
    repeat count once.  Without labelled rows of both kinds, as for empty tables, the seeds alone
    decide: a text with a match scores over a half, any other under it.
    """
    sample = labelled_sample(docs, labels, label, sample_rows).filter("text is not null").persist()
    try:
        grammar = Grammar.seeded()
        grammar.learn(learn_entries(sample))
        matcher = sample.sparkSession.sparkContext.broadcast(grammar.freeze())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in word_blocks(batch.column("text")):
                    x = [pa.array(c) for c in matcher.value.measures(b).T]
                    y = batch.column("y").slice(b.first, b.n_docs)
                    yield pa.RecordBatch.from_arrays([*x, y], names=[*(f"x{i}" for i in range(MEASURES)), "y"])

        schema = "".join(f"x{i} double, " for i in range(MEASURES)) + "y int"
        rows = sample.mapInArrow(tidy(run), schema).toPandas().sort_values(["y", *(f"x{i}" for i in range(MEASURES))])
    finally:
        sample.unpersist()
    y = rows["y"].to_numpy(float)
    if 0 < y.sum() < len(y):
        grammar.curve = _logistic(rows.drop(columns="y").to_numpy(), y)
    else:
        grammar.curve = np.array([-2.0, 2.0, 2.0, 2.0, 0.0, 0.0])
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).  Null scores as
    empty text; a null id stays null; rows that repeat score alike; an empty table stays empty."""
    bound_batches(docs.sparkSession)
    matcher = docs.sparkSession.sparkContext.broadcast(grammar.freeze())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [matcher.value.score(b) for b in word_blocks(batch.column("text"))]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    return _rows(docs).mapInArrow(tidy(run), "doc_id long, score double")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; nulls, repeats and empty tables as in
    ``fit_toxicity`` and ``score_toxicity``; a null id isn't held out."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id",
        crc_split(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
