"""Substring deduplication with a log-structured index of window fingerprints.

A passage is a window of ``window`` consecutive words.  Of the ``gram``-word hashes inside a
window the least one is the window's fingerprint, so equal windows have equal fingerprints,
and a text keeps only about one fingerprint for every twenty words.  The index holds two kinds of immutable
runs, each dealt into buckets by its key and sorted in them: postings ``(fp, doc_id, part, wins)``, a document that has windows
under a fingerprint and one hash of these windows, and edges ``(w, fp, doc_id)``, single windows by their hash.  A new batch of documents

1. is turned into postings dealt and sorted in the same way,
2. is merge-joined with each run of postings, bucket by bucket: history is read where it lies and never
   exchanged; only postings of fingerprints that the batch has, too, are taken from it,
3. settles the fingerprints under which all documents have the same windows, by ``wins``: their windows all start in the least
   document, and none is dealt.  Under the others one document of each ``wins`` has its windows dealt by hash; of
   history only texts of such documents are looked at.  The windows are reduced to
   their least documents, and merge-joined with each run of edges: the verification, by two hashes of 64 bits each, not by the words,
4. loses each word covered by a window that also starts in a document with a smaller id,
5. leaves as runs of level 0 its postings of fingerprints that nobody had before it (of those that several of its
   documents have, the least one's), and as edges the windows under all other fingerprints that nobody had before.
   So a fingerprint keeps one document whose text is read when it is met again, however many have it: of the
   others only what isn't in an earlier document stays, the windows over the edges of a passage, by hash,
6. triggers compaction of any level that has ``fanout`` runs, the one step that rewrites history.

Joins are shuffled unless the measured size of a side allows a broadcast.  No step gathers
the holders of a fingerprint or of a window in one place: both are reduced to their least
document by pre-aggregated sums and joined back, where a hot key's rows can be split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import bound_batches, cut, drop, drop_path, scratch_path, small, tidy

WINDOW, GRAM, FANOUT = 50, 10, 4
#: Batches of a whole table: enough for a compaction.
BATCHES = FANOUT + 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``n`` consecutive values, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = op(out[: len(out) - width], out[width:])
        width *= 2
    return op(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1]) if width < n else out


def _window_minima(b: tk.Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, least gram hash of the window that starts at each word, whether one starts)."""
    n, span = len(b.hash), window - gram + 1
    grams = np.full(n + span, _TOP, dtype=np.uint64)
    at, _ = tk.ngram_starts(b.at, gram)
    all_grams = tk.ngrams(b.hash, gram)
    grams[at] = np.minimum(all_grams[at], _TOP - np.uint64(1))
    starts = np.zeros(n, dtype=bool)
    starts[tk.ngram_starts(b.at, window)[0]] = True
    least = np.where(starts, _sliding(grams, span, np.minimum)[:n], np.uint64(0))
    return grams[:n], least, starts


def _postings(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "part"))
            for b in tk.blocks(batch.column("text"), tk.SPACED, False):
                if len(b.hash) < window:
                    continue
                _, least, starts = _window_minima(b, window, gram)
                if not starts.any():
                    continue
                doc, fp = b.doc_of_word()[starts], least[starts]
                hashes = tk.mix(tk.ngrams(b.hash, window)[np.flatnonzero(starts)])
                order = np.lexsort((fp, doc))
                doc, fp = doc[order], fp[order]
                new = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])
                wins = np.add.reduceat(hashes[order], new)
                doc, fp = b.first + doc[new], fp[new]
                columns = [pa.array(tk.signed(fp)), pa.array(ids[doc]), pa.array(parts[doc]), pa.array(tk.signed(wins))]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "doc_id", "part", "wins"])

    return run


def _under(least: np.ndarray, b: tk.Block, window: int, wanted: np.ndarray, wanted_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block under the fingerprints wanted of their documents: first words, and places in ``wanted``."""
    at, which = [], []
    for d in range(b.n_docs):
        lo, hi = b.at[d], max(b.at[d], b.at[d + 1] - window + 1)
        begin, end = wanted_at[b.first + d], wanted_at[b.first + d + 1]
        if hi == lo or begin == end:
            continue
        order = np.argsort(wanted[begin:end])
        mine = wanted[begin:end][order]
        k = np.minimum(np.searchsorted(mine, least[lo:hi]), end - begin - 1)
        hit = np.flatnonzero(mine[k] == least[lo:hi])
        at.append(lo + hit)
        which.append(begin + order[k[hit]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *which])


def _windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "part"))
            lists = batch.column("fps")
            fps, *said = lists.flatten().flatten()
            wanted = fps.to_numpy().view(np.uint64)
            wanted_at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for b in tk.blocks(batch.column("text"), tk.SPACED, False):
                if len(b.hash) < window:
                    continue
                _, least, _ = _window_minima(b, window, gram)
                at, which = _under(least, b, window, wanted, wanted_at)
                hashes = tk.ngrams(b.hash, window)[at]
                doc = np.searchsorted(b.at, at, side="right") - 1
                pos, row = at - b.at[doc], b.first + doc
                columns = [
                    pa.array(tk.signed(least[at])), pa.array(tk.signed(hashes)), pa.array(ids[row]),
                    pa.array(parts[row]), pa.array(pos.astype(np.int32)), *(c.take(pa.array(which)) for c in said),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "w", "doc_id", "part", "pos", *_SAID])

    return run


def _starts(window: int, gram: int):
    """First words of all windows under the given fingerprints, a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            wanted = lists.flatten().to_numpy().view(np.uint64)
            wanted_at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for b in tk.blocks(batch.column("text"), tk.SPACED, False):
                if len(b.hash) < window:
                    continue
                _, least, _ = _window_minima(b, window, gram)
                at, _ = _under(least, b, window, wanted, wanted_at)
                n = np.searchsorted(at, b.at)
                found = pa.array((at - np.repeat(b.at[:-1], np.diff(n))).astype(np.int32))
                rows = batch.slice(b.first, b.n_docs)
                columns = [rows.column("doc_id"), rows.column("part"), pa.ListArray.from_arrays(pa.array(n, pa.int32()), found)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "found"])

    return run


_POSTING, _EDGE = "fp long, doc_id long, part int, wins long", "w long, fp long, doc_id long"
#: What is known of a posting's class (the documents with one ``fp`` and ``wins``): least document, greatest of the batch, least
#: of history, and whether the posting stands for the class.
_SAID = {"lo": "long", "hi": "long", "old": "long", "lead": "boolean"}
_SPANS = "doc_id long, part int, span_start array<int>, span_end array<int>"


def _spans(window: int):
    """Sorted disjoint word spans from the first words of covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for found in batch.column("found"):
                p = np.unique(found.values.to_numpy())
                new = np.r_[True, np.diff(p) > window]
                starts.append(p[new])
                ends.append(p[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]] + window)
            columns = [batch.column("doc_id"), batch.column("part")]
            columns += [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "span_start", "span_end"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the words that are left, joined by single spaces."""
    for batch in batches:
        span_start, span_end = batch.column("span_start"), batch.column("span_end")
        for b in tk.blocks(batch.column("text"), tk.SPACED, False):
            change = np.zeros(len(b.hash) + 1, dtype=np.int64)
            for d in range(b.n_docs):
                if (s := span_start[b.first + d]).is_valid:
                    change[b.at[d] + s.values.to_numpy()] += 1
                    change[b.at[d] + span_end[b.first + d].values.to_numpy()] -= 1
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            raw = np.r_[b.raw, np.uint8(0x20)]
            edge = np.zeros(len(raw) + 1, dtype=np.int64)
            edge[b.start[kept]] += 1
            edge[b.end[kept]] -= 1
            use = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(b.at, kept, side="right") - 1
            gap = b.end[kept[:-1]][doc[:-1] == doc[1:]]
            raw[gap] = 0x20
            use[gap] = True
            size = np.r_[0, np.cumsum(use)][b.doc_at]
            text = pa.LargeStringArray.from_buffers(
                b.n_docs, pa.py_buffer(size.astype(np.int64).tobytes()), pa.py_buffer(raw[use].tobytes())
            )
            n_kept = np.bincount(doc, minlength=b.n_docs)
            rows = batch.slice(b.first, b.n_docs)
            columns = [rows.column("doc_id"), pa.array(b.words), pa.array(b.words - n_kept), text.cast(pa.string())]
            columns += [rows.column("span_start"), rows.column("span_end")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text", "span_start", "span_end"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells rows with one doc_id apart, and the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("part"), F.col("text").cast("string").alias("text")
    )


class FingerprintIndex:
    """Immutable runs of postings and of edges below a folder that driver and executors share, bucketed and sorted by key.

    ``path``: an index left there is opened again.  ``fanout``: so many runs of one level are
    merged into one of the next.  ``buckets``: of each run; of an index opened again, those it has
    (default: the number of shuffle partitions).
    """

    def __init__(
        self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT,
        buckets: int | None = None,
    ):
        if not 0 < gram <= window:
            raise ValueError("gram must be from 1 to window")
        bound_batches(spark)
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.path = path or scratch_path(spark, "index")
        self.tables: dict[str, str] = {}
        self.runs, self.edges = self._found("run"), self._found("edge")
        old = self.runs or self.edges
        self.buckets = int(old[0][1].rsplit("-", 1)[1]) if old else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _found(self, kind: str) -> list[tuple[int, str]]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [n for n in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n.split("-")[1]), f"{self.path}/{n}") for n in done if n.startswith(f"{kind}-"))

    def _bucketed(self, rows: DataFrame, path: str, dealt: bool = False) -> None:
        """Write the distinct ``rows`` as a table at ``path``, in buckets of the first column, sorted by all.  ``dealt``: they are distinct and dealt by it already."""
        key = rows.columns[0]
        rows = rows if dealt else rows.repartition(self.buckets, key).dropDuplicates()
        rows.sortWithinPartitions(*rows.columns).write.bucketBy(self.buckets, key).sortBy(*rows.columns).option("path", path).format("parquet").saveAsTable(self._name(path))

    def _name(self, path: str) -> str:
        return self.tables.setdefault(path, f"granary_run_{uuid.uuid4().hex}")

    def _write(self, runs: list[tuple[int, str]], level: int, rows: DataFrame) -> None:
        kind = "run" if runs is self.runs else "edge"
        used = [int(p.rsplit("-", 2)[1]) for _, p in runs]
        path = f"{self.path}/{kind}-{level}-{max(used, default=-1) + 1:06d}-{self.buckets}"
        self._bucketed(rows, path)
        runs.append((level, path))

    def _read(self, path: str, columns: str = _POSTING) -> DataFrame:
        """A run as a bucketed table of this session's catalog."""
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            names = [c.split()[0] for c in columns.split(", ")]
            self.spark.sql(
                f"create table {name} ({columns}) using parquet clustered by ({names[0]}) sorted by ({', '.join(names)}) "
                f"into {self.buckets} buckets location '{path}'"
            )
        return self.spark.table(name)

    def _remove(self, path: str) -> None:
        self.spark.sql(f"drop table if exists {self._name(path)}")
        self.tables.pop(path)
        drop_path(self.spark, path)

    def remove(self) -> None:
        """Remove the index and all that it has below ``path``."""
        for path in [p for _, p in [*self.runs, *self.edges]] + list(self.tables):
            self._remove(path)
        self.runs, self.edges = [], []
        drop_path(self.spark, self.path)

    def postings(self) -> DataFrame:
        """All postings of all runs."""
        out = self.spark.createDataFrame([], _POSTING)
        for _, path in self.runs:
            out = out.unionByName(self._read(path))
        return out

    def windows(self) -> DataFrame:
        """All edges of all runs."""
        out = self.spark.createDataFrame([], _EDGE)
        for _, path in self.edges:
            out = out.unionByName(self._read(path, _EDGE))
        return out

    def compact(self) -> None:
        """Merge runs of one kind while some level has ``fanout`` of them."""
        for runs, columns in ((self.runs, _POSTING), (self.edges, _EDGE)):
            while full := [lv for lv in {lv for lv, _ in runs} if sum(x == lv for x, _ in runs) >= self.fanout]:
                old = [r for r in runs if r[0] == min(full)]
                merged = self._read(old[0][1], columns)
                for _, path in old[1:]:
                    merged = merged.unionByName(self._read(path, columns))
                self._write(runs, min(full) + 1, merged)
                for r in old:
                    runs.remove(r)
                    self._remove(r[1])

    def known(self, new: DataFrame, run: str) -> DataFrame:
        """(fp, doc_id, part, wins) of a run for the fingerprints that the bucketed postings ``new`` have, too.

        A merge join of two tables bucketed alike: neither side is exchanged.
        """
        return self._read(run).hint("merge").join(new.select("fp").distinct(), "fp").select("fp", "doc_id", "part", "wins")

    def _with_held(self, met: DataFrame, run: str, name: str) -> DataFrame:
        """The bucketed windows ``met`` with ``name``: their least document in a run of edges, joined like ``known``."""
        theirs = self._read(run, _EDGE).groupBy("w", "fp").agg(F.min("doc_id").alias(name)).select(F.col("w").alias("_w"), F.col("fp").alias("_fp"), name)
        same = F.col("fp").bitwiseXOR(F.col("_fp")) == 0  # no key of the join, which would exchange
        return met.hint("merge").join(theirs, (F.col("w") == F.col("_w")) & same, "left").drop("_w", "_fp")

    def deduplicate(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Add a batch and remove from it what documents with smaller ids have, in it or before it.

        ``history``: the documents indexed so far, for the windows of those that the index finds.  One row
        per row of the batch: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` and the removed
        word spans ``span_start[i]:span_end[i]`` (null: none).  Null and empty texts have no
        words; rows with a null id keep all words and take none from others; rows that repeat
        an id are compared by text, and none of them is earlier than another; an empty batch
        gives no rows.
        """
        fresh, met = (f"{self.path}/{what}-{uuid.uuid4().hex}" for what in ("batch", "met"))
        rows = _keyed(batch).filter("doc_id is not null and text is not null")
        self._bucketed(rows.mapInArrow(tidy(_postings(self.window, self.gram)), _POSTING), fresh)
        new = self._read(fresh)
        found = self.spark.createDataFrame([], _POSTING)
        for _, path in self.runs if history is not None else []:
            found = found.unionByName(self.known(new, path))
        found = cut(found, "known")
        old = found.groupBy("fp").agg(F.min("doc_id").alias("old"), F.min("wins").alias("o1"), F.max("wins").alias("o2"))
        ends = new.groupBy("fp").agg(
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("wins").alias("w1"), F.max("wins").alias("w2")
        )
        # settled: all have the same windows under it, and no edge of the index can be of an earlier document
        settled = (F.least("w1", "o1") == F.greatest("w2", "o2")) & F.expr("old is null or old <= lo")
        settled = settled & F.lit(history is not None or not self.edges)
        # lo: of a fingerprint that is new to the index the least document, which keeps its posting; first: the least of all
        shared = ends.join(old, "fp", "left").filter("lo < hi or old is not null").select(
            "fp", F.when(F.col("old").isNull(), F.col("lo")).alias("lo"), F.least("lo", "old").alias("first"), settled.alias("settled")
        )
        shared = cut(shared, "shared")
        few = small(shared, shared.count() * 32)
        apart = few.filter("not settled").select("fp")
        mine, theirs = new.join(apart, "fp", "left_semi"), found.join(apart, "fp", "left_semi")
        every = mine.withColumn("mine", F.lit(True)).unionByName(theirs.withColumn("mine", F.lit(False)))
        classes = every.groupBy("fp", "wins").agg(
            F.min("doc_id").alias("lo"), F.max(F.when(F.col("mine"), F.col("doc_id"))).alias("hi"),
            F.min(F.when(~F.col("mine"), F.col("doc_id"))).alias("old"), F.min(F.when(F.col("mine"), F.struct("doc_id", "part"))).alias("head"),
        )
        classes = cut(classes, "classes")
        heads = small(classes, classes.count() * 64)
        mine = mine.join(heads, ["fp", "wins"]).withColumn("lead", F.col("head") == F.struct("doc_id", "part"))
        windows = self._windows_of(_keyed(batch), mine)
        every = windows.filter("lead").select("fp", "w", "lo", "hi", "old")
        if history is not None and not found.isEmpty():
            # texts of history only for classes that no document of the batch is in
            theirs = theirs.join(heads.filter("hi is null"), ["fp", "wins"]).withColumn("lead", F.lit(True))
            every = every.unionByName(self._windows_of(_keyed(history), theirs).select("fp", "w", "lo", "hi", "old"))
        least = every.groupBy("w").agg(*[f(c).alias(c) for f, c in ((F.min, "fp"), (F.min, "lo"), (F.min, "old"), (F.max, "hi"))])
        self._bucketed(least.filter("hi is not null"), met, dealt=True)
        held = [f"held{k}" for k in range(len(self.edges))]
        met_ = self._read(met, "w long, fp long, lo long, old long, hi long")
        for name, (_, path) in zip(held, self.edges, strict=True):
            met_ = self._with_held(met_, path, name)
        before = F.least(F.lit(None).cast("long"), F.lit(None).cast("long"), *held)
        least = cut(met_.select("w", "fp", "lo", "old", "hi", before.alias("held")), "least")
        first = cut(least.withColumn("lo", F.least("lo", "held")).filter("lo < hi").select("w", "lo"), "first")
        # read anew, so that the join can split a hot window where it isn't broadcast
        later = windows.select("w", "doc_id", "part", "pos").join(small(first, first.count() * 16), "w").filter("doc_id > lo")
        spans = later.groupBy("doc_id", "part").agg(F.collect_set("pos").alias("found"))
        copied = new.join(few.filter("settled").select("fp", "first"), "fp").filter("doc_id > first").select("fp", "doc_id", "part")
        spans = spans.unionByName(self._starts_of(_keyed(batch), copied)).groupBy("doc_id", "part").agg(F.flatten(F.collect_set("found")).alias("found"))
        spans = cut(spans.mapInArrow(tidy(_spans(self.window)), _SPANS), "spans")
        kept = new.join(few.select("fp", F.col("lo").alias("_lo"), F.lit(True).alias("_met")), "fp", "left")
        self._write(self.runs, 0, kept.filter("_met is null or doc_id = _lo").select("fp", "doc_id", "part", "wins"))
        # windows that start nowhere before the batch, but for those of the document that keeps the posting
        edges = least.filter("(old is null or lo < old) and (held is null or lo < held)").select("w", "fp", F.col("lo").alias("doc_id"))
        edges = edges.join(few.select("fp", F.col("lo").alias("_lo")), "fp").filter("_lo is null or _lo <> doc_id").select("w", "fp", "doc_id")
        self._write(self.edges, 0, edges)
        self._remove(fresh)
        self._remove(met)
        drop(found, shared, classes, least, first, *self._lists)
        self._lists = []
        self.compact()
        size = spans.agg(F.sum(F.size("span_start") * 8 + 48)).first()[0] or 0
        return _keyed(batch).join(small(spans, size), ["doc_id", "part"], "left").mapInArrow(
            tidy(_without),
            "doc_id long, n_words long, n_removed long, kept_text string, span_start array<int>, span_end array<int>",
        )

    _lists: list[DataFrame] = []

    def _texts_of(self, rows: DataFrame, postings: DataFrame, what: Column, n_bytes: int) -> DataFrame:
        """Texts of the documents of the postings, each with the list ``fps`` of its own."""
        lists = cut(postings.groupBy("doc_id", "part").agg(F.collect_set(what).alias("fps")), "fps")
        self._lists = [*self._lists, lists]
        size = lists.agg(F.sum(F.size("fps") * n_bytes + 48)).first()[0] or 0
        return rows.filter("text is not null").join(small(lists, size), ["doc_id", "part"])

    def _windows_of(self, rows: DataFrame, postings: DataFrame) -> DataFrame:
        """Hashed windows under the given postings with what is known of these, from the texts of their documents only."""
        texts = self._texts_of(rows, postings, F.struct("fp", *_SAID), 64)
        known = ", ".join(f"{c} {kind}" for c, kind in _SAID.items())
        return texts.mapInArrow(tidy(_windows(self.window, self.gram)), f"fp long, w long, doc_id long, part int, pos int, {known}")

    def _starts_of(self, rows: DataFrame, postings: DataFrame) -> DataFrame:
        """First words of all windows under the given postings, from the texts of their documents only."""
        texts = self._texts_of(rows, postings, F.col("fp"), 8)
        return texts.mapInArrow(tidy(_starts(self.window, self.gram)), "doc_id long, part int, found array<int>")


def deduplicate_substrings(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Whole table in ``batches`` steps of rising ``doc_id`` through one index (see ``deduplicate``), which is removed at the end."""
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        out = index.deduplicate(docs)
        index.remove()
        return out
    edges = [low + (high + 1 - low) * i // batches for i in range(1, batches)]
    edges = sorted({e for e in edges if low < e <= high})
    out = None
    try:
        for i, (a, b) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
            after = F.lit(True) if a is None else F.col("doc_id") >= a
            inside = after & (F.lit(True) if b is None else F.col("doc_id") < b)
            batch = docs.filter(inside | F.col("doc_id").isNull() if i == 0 else inside)
            part = index.deduplicate(batch, docs.filter(F.col("doc_id") < a) if i else None)
            out = part if out is None else out.unionByName(part)
    finally:
        index.remove()  # its tables are in the user's catalog
    return out


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    return deduplicate_substrings(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
win as (
  select rid, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as t
  from d, unnest(range(1, len(w) - 48)) as r(i) where len(w) >= 50),
lo as (select t, min(doc_id) as lo from win group by t),
gone as (
  select distinct rid, p from (
    select rid, unnest(range(i, i + 50)) as p from win join lo using (t) where doc_id > lo)),
kept as (
  select d.rid, string_agg(w[r.p], ' ' order by r.p) as k, count(*) as n
  from d, unnest(range(1, len(w) + 1)) as r(p) anti join gone on gone.rid = d.rid and gone.p = r.p group by d.rid)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed,
  sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (rid)
"""
