"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors become one vertex with a weight (pre-aggregated).
2. Centroids are fitted on a bounded sample, in two levels beyond CLUSTERS of them, so that a cluster has
   about CLUSTER_ROWS vertices however many there are.  A centroid in the thick of a skewed table would draw most of it, so each has a
   price, fitted on the sample until clusters are about equal, that is taken off its cosine.  Each vertex is a member of its ``overlap``
   nearest clusters, so clusters overlap, and a visitor of VISITS more.  A cluster over ``unit_rows`` is cut into blocks, and each
   pair of blocks makes a unit; its visitors are cut into slices of so many, and each meets each block in a unit of its own.
   So no task holds more than two blocks, or a block and a slice.
3. In each unit a graph is built of its members by inserting them in doubling batches: a greedy search
   from the medoid gives candidates, robust pruning keeps those that no kept one is nearer to
   by the factor ``alpha``.
4. The adjacency lists that a vertex has in several units are united.
5. Every vertex searches the units that it belongs to or visits on the united lists, greedily from the medoid; from each vertex in
   range found, the search goes on over its neighbours until nothing more is in range.  So a pair is met
   where either end belongs to a cluster that the other belongs to or visits.
6. Pairs found are verified by cosine in double precision and counted once, in the least
   cluster in which they can meet.
7. Recall is audited against brute force over all vertices, for growing blocks of vertices by a hash, until
   linked ones of ``AUDITED_GROUPS`` groups were seen or ``AUDIT_ROWS`` vertices are used, so its cost grows with the table and
   not with its square.  It is the least
   of three shares: of links, of each linked vertex's pairs, and of each group's pairs; and of a fourth, that doesn't depend on how
   rare links are: of PROBES vertices turned to a cosine between the threshold and 1, which visit clusters and search like any
   vertex but are nobody's neighbours, those that find the vertex that they were turned from.  Under
   ``recall``, the search is repeated with twice the beam and one more cluster for each vertex;
   if the widest beam fails too, or brute force costs less than the next one, the links are found by brute force, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, drop, scratch_path, small, tidy
from .components import connected_components

COSINE, RECALL = 0.95, 0.9
CLUSTER_ROWS, UNIT_ROWS, CLUSTERS, FIT_ROWS, OVERLAP = 1_500, 4_096, 1_024, 20_000, 2
#: Clusters that a vertex visits beside its own; those of the upper level in which it looks for them; rows that the centroids of each are fitted on.
VISITS, UPPER, LOWER_FIT_ROWS = 2, 2, 5_000
DEGREE, BEAM, ALPHA, BATCH = 24, 32, 1.2, 512
#: Vertices in the first block of an audit (it doubles up to BLOCK_ROWS), groups that it has to see, and vertices that it takes at most.
AUDITED, AUDITED_GROUPS, BLOCK_ROWS, AUDIT_ROWS = 256, 100, 4_096, 32_768
#: Turned vertices whose search is audited, whatever the size of the table.
PROBES = 1_000
_SLICE = 1_024
#: What a comparison of gathered vertices costs, in comparisons of a product of matrices.
GATHERED = 16


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, as squares of large ones overflow and of small ones vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample, from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where((size > 1e-12)[:, None], sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def priced(x: np.ndarray, c: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Centroids with their prices as a last column: those under which the largest cluster of the sample is the smallest that was seen.

    The price of a cluster over the average rises, of one under it falls, by ever smaller steps of the cosines' spread.
    """
    cosine = (x @ c.T).astype(np.float32)
    price, best, step = np.zeros(len(c), np.float32), (len(x) + 1, np.zeros(len(c))), float(cosine.std()) / 4
    for _ in range(rounds if len(c) > 1 else 0):
        size = np.bincount(np.argmax(cosine - price, axis=1), minlength=len(c))
        if size.max() < best[0]:
            best = int(size.max()), price.astype(np.float64)
        price += (step * np.clip(size * len(c) / len(x) - 1, -1, 2)).astype(np.float32)
        step *= 0.97
    return np.c_[c, best[1]]


def _score(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines with priced centroids, less the prices."""
    return x @ c[:, :-1].T - c[:, -1]


def greedy_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam of the nearest vertices found for each query, nearest first: (ids, cosines).

    All queries step together; ``graph`` holds neighbours, -1 for none.
    """
    q = len(queries)
    ids = np.full((q, beam), -1, dtype=np.int64)
    near = np.full((q, beam), -2.0, dtype=x.dtype)
    done = np.zeros((q, beam), dtype=bool)
    ids[:, 0], near[:, 0] = start, queries @ x[start]
    live = np.arange(q)
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        best = np.argmax(open_, axis=1)
        on = open_[np.arange(len(live)), best]
        live, best = live[on], best[on]
        if not len(live):
            break
        done[live, best] = True
        more = graph[ids[live, best]]
        known = (more[:, :, None] == ids[live][:, None, :]).any(axis=2) | (more < 0)
        score = np.einsum("qrd,qd->qr", x[more], queries[live])
        score[known] = -2.0
        all_ids, all_near = np.concatenate([ids[live], np.where(known, -1, more)], axis=1), np.concatenate([near[live], score], axis=1)
        all_done = np.concatenate([done[live], np.zeros(more.shape, bool)], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[live], near[live], done[live] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_near, all_done))
    return ids, near


def robust_prune(x: np.ndarray, vertex: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours, nearest first, without those that a kept one covers."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != vertex)])
    far = 1 - x[candidates] @ x[vertex]
    order = np.argsort(far, kind="stable")
    candidates, far = candidates[order], np.maximum(far[order], 0)
    if len(candidates) <= degree // 2:
        return candidates
    between = 1 - x[candidates] @ x[candidates].T
    free = np.ones(len(candidates), dtype=bool)
    kept = []
    for i in range(len(candidates)):
        if free[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            free &= alpha * between[i] > far
    return candidates[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each vertex, medoid)."""
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int64)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    rest = np.r_[medoid, np.delete(np.arange(n), medoid)]
    at, size = 1, 1
    while at < n:
        new = rest[at : at + size]
        ids, _ = greedy_search(x, graph, medoid, x[new], beam)
        back: dict[int, list[int]] = {}
        for v, found in zip(new.tolist(), ids, strict=True):
            kept = robust_prune(x, v, found, degree, alpha)
            graph[v, : len(kept)] = kept
            for u in kept.tolist():
                back.setdefault(u, []).append(v)
        for u, more in back.items():
            old = graph[u][graph[u] >= 0]
            both = np.r_[old, more]
            if len(both) > degree:
                both = robust_prune(x, u, both, degree, alpha)
            graph[u] = -1
            graph[u, : len(both)] = both
        at += size
        size = min(2 * size, BATCH)
    return graph, medoid


def range_search(x: np.ndarray, graph: np.ndarray, start: int, least: float, beam: int, visitors: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix (queries by vertices) of the pairs with cosine over ``least`` that greedy search and expansion find.

    The queries are the vertices themselves, or ``visitors`` if there are any.
    """
    n = len(x)
    queries = x if visitors is None else visitors
    found = np.zeros((len(queries), n), dtype=bool)
    for i in range(0, len(queries), BATCH):
        ids, near = greedy_search(x, graph, start, queries[i : i + BATCH], beam)
        for q in range(len(ids)):
            me = i + q
            front = ids[q][(near[q] >= least) & (ids[q] >= 0)]
            front = np.unique(np.r_[front, me]) if visitors is None else front
            seen = np.zeros(n, dtype=bool)
            seen[front] = True
            while len(front):
                found[me, front] = True
                more = graph[front].ravel()
                more = np.unique(more[more >= 0])
                more = more[~seen[more]]
                seen[more] = True
                front = more[x[more] @ queries[me] >= least]
    if visitors is None:
        np.fill_diagonal(found, False)
        found |= found.T
    return found


def _table(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors in double precision)."""
    v = batch.column("v").combine_chunks()
    ids = batch.column("vid").to_numpy()
    return ids, _unit(v.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))


def _build(degree: int, beam: int, alpha: float):
    def run(unit: pa.Table) -> pa.Table:
        ids, x = _table(unit)
        order = np.argsort(ids)
        ids, x = ids[order], x[order].astype(np.float32)
        graph, _ = build_graph(x, degree, beam, alpha)
        lists = [ids[g[g >= 0]] for g in graph]
        return pa.table({"vid": pa.array(ids), "near": pa.array(lists, pa.list_(pa.int64()))})

    return run


def _meeting(clusters: np.ndarray, u: int, v: np.ndarray, overlap: int) -> np.ndarray:
    """Least cluster that u or each of v belongs to and the other belongs to or visits."""
    mine, theirs = clusters[u], clusters[v]
    far = np.int64(1) << 62
    a = np.where((theirs[:, :overlap, None] == mine[None, None, :]).any(axis=2), theirs[:, :overlap], far)
    b = np.where((theirs[:, :, None] == mine[None, None, :overlap]).any(axis=2), theirs, far)
    return np.minimum(a.min(axis=1), b.min(axis=1))


def _turned(least: float):
    """Vertices turned by a random angle to a cosine over ``least``, with the negative of their id and no weight; nothing in one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _table(pa.Table.from_batches([batch]))
            if x.shape[1] < 2:
                continue
            out = np.empty_like(x)
            for i, (vid, v) in enumerate(zip(ids.tolist(), x, strict=True)):
                rnd = np.random.default_rng(vid)
                side = rnd.normal(size=len(v))
                side -= (side @ v) * v
                t = least + (1 - least) * (0.001 + 0.998 * rnd.random())
                out[i] = t * v + np.sqrt(1 - t * t) * side / np.linalg.norm(side)
            columns = [pa.array(-1 - ids), pa.array(list(out), pa.list_(pa.float64())), pa.array(np.zeros(len(ids), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["vid", "v", "weight"])

    return run


def _search(least: float, beam: int, overlap: int):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.take(pa.array(np.argsort(~unit.column("member").to_numpy(), kind="stable")))  # members first
        ids, x = _table(unit)
        n, k = len(ids), int(unit.column("member").to_numpy().sum())
        links, pairs, label = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), ids.copy()
        if k:
            lists = unit.column("near").combine_chunks().slice(0, k)
            size = lists.value_lengths().fill_null(0).to_numpy()
            to = lists.flatten().to_numpy()
            order = np.argsort(ids[:k])
            at = np.minimum(np.searchsorted(ids[:k], to, sorter=order), k - 1)
            to = np.where(ids[order[at]] == to, order[at], -1)
            graph = np.full((k, max(1, int(size.max()))), -1, dtype=np.int64)
            graph[np.repeat(np.arange(k), size), np.arange(len(to)) - np.repeat(np.cumsum(size) - size, size)] = to
            low = x.astype(np.float32)
            visited = unit.column("slice")[0].as_py() > 0
            first = k if visited else 0  # members search for themselves where there are no visitors
            found = range_search(low[:k], graph, int(np.argmax(low[:k] @ low[:k].mean(axis=0))), least - 1e-4, beam, low[k:] if visited else None)
            weight, block = unit.column("weight").to_numpy(), unit.column("block").to_numpy()
            one_block = unit.column("b1")[0] == unit.column("b2")[0]
            cluster = unit.column("cluster")[0].as_py()
            clusters = unit.column("clusters").combine_chunks()
            clusters = clusters.flatten().to_numpy().reshape(n, -1)
            near: list[np.ndarray] = []
            for u in range(first, n):
                v = np.flatnonzero(found[u - first])
                v = v[x[v] @ x[u] >= least]
                if ids[u] < 0:  # a probe: links and groups don't see it
                    pairs[u] = int((ids[v] == -1 - ids[u]).any())
                    v = v[:0]
                near.append(v)
                if len(v):
                    mine = v[(_meeting(clusters, u, v, overlap) == cluster) & (one_block | (block[v] != block[u]))]
                    links[u] += weight[mine].sum()
                    pairs[u] += len(mine)
                    if u >= k:  # members don't look for visitors
                        links[mine] += weight[u]
                        pairs[mine] += 1
            while True:
                before = label.copy()
                for u, v in enumerate(near, first):
                    if len(v):
                        label[u] = min(label[u], label[v].min())
                        label[v] = np.minimum(label[v], label[u])
                if (before == label).all():
                    break
        return pa.table({"vid": pa.array(ids), "links": pa.array(links), "pairs": pa.array(pairs), "root": pa.array(label)})

    return run


class NearVectors:
    """Links between vectors with cosine of at least ``cosine``, with an audit.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored.  A vector that is null,
    empty, zero or holds a null or a component that isn't finite links with nothing; vectors
    of different lengths don't link; equal vectors link with each other.  Rows that repeat an
    id are vectors of their own with one name; an empty table gives no rows.  After ``result()``, ``audited`` holds the recall
    of the links of audited vectors and of probes (1.0 after brute force); it is never
    under ``recall``.
    """

    def __init__(self, vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, unit_rows: int = UNIT_ROWS):
        self.spark, self.cosine, self.recall, self.unit_rows = vectors.sparkSession, cosine, recall, unit_rows
        self.audited = self.planted = 1.0
        self._tables: list[DataFrame] = []
        v = F.transform("embedding", lambda e: e.cast("double"))
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda e: e != 0)
        self.rows = rows.withColumn("v", F.when(fine & F.col("vec_id").isNotNull(), F.col("v")))
        groups = self.rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
        #: One vertex for each distinct vector.
        self.vertices = cut(groups.withColumn("vid", F.monotonically_increasing_id()), "vertices")

    def _clusters(self, rows: DataFrame, n: int, keep: int) -> DataFrame:
        """vid, v, weight and ``clusters``: the numbers of the ``keep`` nearest clusters (fewer if there are fewer), nearest first."""
        k = max(1, -(-n // CLUSTER_ROWS))
        sample = rows.orderBy(F.xxhash64("vid"), "vid").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
        x = _unit(sample.flatten().to_numpy().reshape(len(sample), -1))
        upper = min(k, CLUSTERS, len(x))
        shared = self.spark.sparkContext.broadcast(priced(x, fit_centroids(x, upper)))
        lower = min(-(-k // upper), CLUSTERS)
        near = min(keep if lower == 1 else UPPER, upper)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, x = _table(pa.Table.from_batches([batch]))
                lists = np.argsort(-_score(x, shared.value), axis=1, kind="stable")[:, :near].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int64()))], names=[*batch.schema.names, "clusters"])

        rows = rows.select("vid", "v", "weight").mapInArrow(tidy(assign), "vid long, v array<double>, weight long, clusters array<long>")
        rows = self._cut(rows, "clusters")
        return rows if lower == 1 else self._lower_clusters(rows, upper, lower, keep, x.shape[1])

    def _lower_clusters(self, rows: DataFrame, upper: int, lower: int, keep: int, width: int) -> DataFrame:
        """The same from a second level: each upper cluster has centroids of its own, fitted on a bounded sample of its
        rows; they are sent for so many upper clusters at a time as the bound of a broadcast allows."""
        mine = rows.select(F.get("clusters", F.lit(0)).alias("top"), "vid", "v")
        place = F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64("vid"), "vid"))
        sample = mine.withColumn("place", place).filter(F.col("place") <= LOWER_FIT_ROWS).select("top", "vid", "v")

        def fit(group: pa.Table) -> pa.Table:
            ids, x = _table(group)
            x = x[np.argsort(ids)]
            c = priced(x, fit_centroids(x, min(lower, len(x))))
            top = group.column("top")[0].as_py()
            return pa.table({"top": pa.array([top] * len(c), pa.int64()), "c": pa.array(list(c), pa.list_(pa.float64()))})

        fitted = self._cut(sample.groupBy("top").applyInArrow(fit, "top long, c array<double>"), "centroids")
        some = max(1, BROADCAST_BYTES // (8 * (width + 1) * lower))
        path = scratch_path(self.spark, "nearest")
        for first in range(0, upper, some):
            inside = fitted.filter(F.col("top").between(first, first + some - 1)).toArrow()
            tops, c = inside.column("top").to_numpy(), inside.column("c").combine_chunks().flatten().to_numpy().reshape(-1, width + 1)
            shared = self.spark.sparkContext.broadcast({int(t): c[tops == t] for t in np.unique(tops)})

            def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids, x = _table(pa.Table.from_batches([batch]))
                    tops = batch.column("top").to_numpy()
                    for t in np.unique(tops).tolist():
                        if (c := shared.value.get(t)) is None:
                            continue
                        on = np.flatnonzero(tops == t)
                        cosine = _score(x[on], c)
                        best = np.argsort(-cosine, axis=1, kind="stable")[:, :keep]
                        columns = [np.repeat(ids[on], best.shape[1]), (t * CLUSTERS + best).ravel(), -np.take_along_axis(cosine, best, axis=1).ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names=["vid", "cluster", "far"])

            looking = rows.select("vid", "v", F.explode("clusters").alias("top")).filter(F.col("top").between(first, first + some - 1))
            looking.mapInArrow(tidy(nearest), "vid long, cluster long, far double").write.mode("append").parquet(path)
            shared.destroy()
        found = self.spark.read.schema("vid long, cluster long, far double").parquet(path)
        self._tables.append(found)
        best = F.slice(F.array_sort(F.collect_list(F.struct("far", "cluster"))), 1, keep)
        # lists are as long as each other: the last cluster is repeated where fewer were found
        best = found.groupBy("vid").agg(best.alias("best")).select("vid", F.col("best.cluster").alias("clusters"))
        full = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.get("clusters", F.least(i, F.size("clusters") - 1)))
        return self._cut(rows.drop("clusters").join(best, "vid").select("vid", "v", "weight", full.alias("clusters")), "clusters")

    def _units(self, rows: DataFrame, n: int, overlap: int) -> DataFrame:
        """Rows of units: a vertex once for each unit that it belongs to or visits."""
        rows = self._clusters(rows, n, overlap + VISITS)
        at = F.posexplode(F.array_distinct("clusters")).alias("place", "cluster")
        rows = rows.select("vid", "v", "weight", "clusters", at).withColumn("member", (F.col("place") < overlap) & (F.col("vid") >= 0))
        parts = lambda n: F.ceil(n / self.unit_rows).cast("int")
        sizes = rows.groupBy("cluster").agg(F.count_if("member").alias("size"), F.count_if(~F.col("member")).alias("guests"))
        sizes = self._cut(sizes.select("cluster", parts(F.col("size")).alias("m"), parts(F.col("guests")).alias("g")), "sizes")
        rows = rows.join(small(sizes, sizes.count() * 16), "cluster").filter("m > 0")
        rows = rows.withColumn("block", F.when(F.col("member"), F.pmod(F.xxhash64("vid"), F.col("m")).cast("int")).otherwise(-1))
        rows = rows.withColumn("mine", F.when(~F.col("member"), F.pmod(F.xxhash64("vid", F.lit(2)), F.col("g")).cast("int") + 1))
        unit = lambda a, b, s: F.struct(a.alias("b1"), b.alias("b2"), s.alias("slice"))
        every, none = F.sequence(F.lit(0), F.col("m") - 1), F.array().cast("array<struct<b1:int,b2:int,slice:int>>")
        pairs = F.transform(every, lambda j: unit(F.least("block", j), F.greatest("block", j), F.lit(0)))
        hosts = F.when(F.col("g") > 0, F.transform(F.sequence(F.lit(1), F.col("g")), lambda s: unit(F.col("block"), F.col("block"), s))).otherwise(none)
        visits = F.transform(every, lambda j: unit(j, j, F.col("mine")))
        rows = rows.withColumn("p", F.explode(F.when(F.col("member"), F.concat(pairs, hosts)).otherwise(visits)))
        return rows.select("vid", "v", "weight", "clusters", "cluster", "member", "block", "p.b1", "p.b2", "p.slice")

    def _links(self, rows: DataFrame, n: int, overlap: int, beam: int) -> DataFrame:
        some = rows.orderBy(F.xxhash64("vid", F.lit(5)), "vid").limit(PROBES).select("vid", "v")
        probes = self._cut(some.mapInArrow(_turned(self.cosine), "vid long, v array<double>, weight long"), "probes")
        units = self._units(rows.select("vid", "v", "weight").unionByName(probes), n, overlap)
        unit = ["cluster", "b1", "b2", "slice"]
        built = units.filter("member and slice = 0").groupBy(*unit).applyInArrow(_build(DEGREE, beam, ALPHA), "vid long, near array<long>")
        near = self._cut(built.groupBy("vid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        searched = units.join(near, "vid", "left").groupBy(*unit).applyInArrow(
            _search(self.cosine, beam, overlap), "vid long, links long, pairs long, root long"
        )
        both = self._cut(searched, "searched")
        turned = both.filter("vid < 0").groupBy("vid").agg(F.max("pairs").alias("found"))
        seen = probes.join(turned, "vid", "left").agg(F.avg(F.coalesce("found", F.lit(0)))).first()[0]
        self.planted = 1.0 if seen is None else float(seen)
        found = cut(both.filter("vid >= 0"), "found")
        drop(*self._tables)
        self._tables = []
        return found

    def _cut(self, df: DataFrame, what: str) -> DataFrame:
        """A table that goes once the links are found."""
        self._tables.append(cut(df, what))
        return self._tables[-1]

    def _blocks(self, rows: DataFrame, n: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All vertices in the order of a hash, in blocks of about ``first`` rows, doubling to the bound."""
        parts = max(1, -(-n // first))
        bound = max(1, min(BLOCK_ROWS, BROADCAST_BYTES // (8 * rows.select(F.size("v")).first()[0])) // first)
        at, size = 0, 1
        while at < parts:
            block = rows.filter(F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(parts)).between(at, at + size - 1))
            block = block.select("vid", "v").toArrow()
            if len(block):
                yield _table(block)
            at, size = at + size, min(2 * size, bound)

    def _audit(self, rows: DataFrame, found: DataFrame, components: DataFrame, n: int) -> float:
        """Recall of ``found`` by brute force: the least of the shares of links, of the pairs of a
        linked vertex and of the pairs of a group."""
        least = self.cosine
        labelled = rows.join(small(components.withColumnRenamed("id", "vid"), n * 16), "vid", "left")
        labelled = cut(labelled.select("vid", "v", "weight", F.coalesce("component", "vid").alias("component")), "audit")
        sums = found.groupBy("vid").agg(F.sum("links").alias("got"), F.sum("pairs").alias("got_pairs"))
        sums = cut(sums, "sums")
        got = true = audited = 0
        shares: list[float] = []
        groups: dict[int, list[float]] = {}
        for ids, x in self._blocks(rows, n, AUDITED):
            shared = self.spark.sparkContext.broadcast((ids, x))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qs, q = shared.value
                for batch in batches:
                    ids, x = _table(pa.Table.from_batches([batch]))
                    weight, component = batch.column("weight").to_numpy(), batch.column("component").to_numpy()
                    for i in range(0, len(ids), _SLICE):
                        k = slice(i, i + _SLICE)
                        a, b = np.nonzero((x[k] @ q.T >= least) & (ids[k][:, None] != qs[None, :]))
                        on, b = np.unique(b, return_inverse=True)
                        links, group = np.zeros(len(on), np.int64), np.full(len(on), np.iinfo(np.int64).max)
                        np.add.at(links, b, weight[k][a])
                        np.minimum.at(group, b, component[k][a])
                        columns = [qs[on], links, np.bincount(b, minlength=len(on)), group]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vid", "links", "pairs", "group"])

            hits = labelled.mapInArrow(run, "vid long, links long, pairs long, group long").groupBy("vid")
            hits = hits.agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"), F.min("group").alias("group"))
            for r in F.broadcast(hits).join(sums, "vid", "left").toLocalIterator():
                got, true = got + min(r.got or 0, r.links), true + r.links
                shares.append(min(r.got_pairs or 0, r.pairs) / r.pairs)
                groups.setdefault(r.group, []).append(shares[-1])
            shared.destroy()
            audited += len(ids)
            if len(groups) >= AUDITED_GROUPS or audited >= AUDIT_ROWS:
                break
        drop(labelled)
        drop(sums)
        if not groups:
            return 1.0
        return float(min(got / true, np.mean(shares), np.mean([np.mean(g) for g in groups.values()])))

    def _exact(self, rows: DataFrame, n: int) -> DataFrame:
        """The links by brute force, a block of vertices against all at a time."""
        least, schema = self.cosine, "vid long, links long, pairs long, root long"
        path = scratch_path(self.spark, "exact")
        for ids, x in self._blocks(rows, n, min(n, BLOCK_ROWS)):
            shared = self.spark.sparkContext.broadcast((ids, x))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qs, q = shared.value
                for batch in batches:
                    ids, x = _table(pa.Table.from_batches([batch]))
                    weight = batch.column("weight").to_numpy()
                    for i in range(0, len(ids), _SLICE):
                        k = slice(i, i + _SLICE)
                        hit = (x[k] @ q.T >= least) & (ids[k][:, None] != qs[None, :])
                        a, b = np.nonzero(hit)
                        links, mine, others = np.zeros(len(qs), np.int64), ids[k].copy(), qs.copy()
                        np.add.at(links, b, weight[k][a])
                        while True:
                            before = mine.sum(), others.sum()
                            np.minimum.at(others, b, mine[a])
                            np.minimum.at(mine, a, others[b])
                            if (mine.sum(), others.sum()) == before:
                                break
                        on, of = hit.any(axis=0), hit.any(axis=1)
                        none = np.zeros(int(of.sum()), np.int64)
                        columns = [
                            np.r_[qs[on], ids[k][of]], np.r_[links[on], none], np.r_[hit.sum(axis=0)[on], none], np.r_[others[on], mine[of]],
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vid", "links", "pairs", "root"])

            rows.select("vid", "v", "weight").mapInArrow(run, schema).write.mode("append").parquet(path)
            shared.destroy()
        return self.spark.read.schema(schema).parquet(path)

    def result(self) -> DataFrame:
        """vec_id, n_links, component_id, kept and the audited ``recall`` of all links, for every row."""
        lengths = [r[0] for r in self.vertices.groupBy(F.size("v").alias("d")).count().filter("count > 1").select("d").orderBy("d").collect()]
        found, roots, recalls = None, None, []
        for d in lengths:
            rows = self.vertices.filter(F.size("v") == d)
            n, overlap, beam = rows.count(), OVERLAP, BEAM
            while True:
                # a wider beam compares each vertex with so many others, brute force with all, but in one product of matrices
                exact = beam > 16 * BEAM or (beam > BEAM and n <= (overlap + VISITS) * beam * DEGREE * GATHERED)
                part = self._exact(rows, n) if exact else self._links(rows, n, overlap, beam)
                tops = connected_components(part.select(F.col("vid").alias("a"), F.col("root").alias("b")))
                recall = 1.0 if exact else min(self.planted, self._audit(rows, part, tops, n))
                if exact or recall >= self.recall:
                    break
                drop(part)
                overlap, beam = overlap + 1, 2 * beam
            recalls.append(recall)
            found = part if found is None else found.unionByName(part)
            roots = tops if roots is None else roots.unionByName(tops)
        self.audited = min(recalls, default=1.0)
        if found is None:
            found = self.spark.createDataFrame([], "vid long, links long")
            roots = self.spark.createDataFrame([], "id long, component long")
        counts = found.groupBy("vid").agg(F.sum("links").alias("links"))
        named = self.vertices.join(counts, "vid", "left").join(roots.withColumnRenamed("id", "vid"), "vid", "left")
        named = cut(named.select("vid", "v", "least", "weight", "links", F.coalesce("component", "vid").alias("component")), "named")
        tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
        tops = cut(tops, "tops")
        out = named.join(small(tops, tops.count() * 16), "component")
        out = cut(out.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "classes")
        size = (out.agg(F.sum(F.size("v"))).first()[0] or 0) * 8
        joined = self.rows.join(small(out, size), "v", "left")
        component = F.coalesce("component_id", "vec_id")
        return joined.select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(self.audited).alias("recall"),
        )


def op10_near_vectors(vectors: DataFrame) -> DataFrame:
    return NearVectors(vectors).result().drop("recall")


ORACLE = r"""
with recursive v as materialized (
  select vec_id, [x::double for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
p as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select a, a from p union select r.a, p.b from reach r join p on r.b = p.a),
c as (select a, min(b) as c from reach group by a),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
