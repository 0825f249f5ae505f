"""Problem 5: the most similar vectors of every vector, by balanced posting lists whose centroids are searched through a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.operators.ranking import grouped_rank
from grainfield.session import stored

#: Vectors the centroids are fitted on, at most; every vector is indexed.
SAMPLE = 65_536
#: Vectors for each posting list, and most lists.
PER_LIST, MOST_LISTS = 400, 16_384
#: Rows of one side of a list that one task compares at once; larger lists become a grid of such tasks.
BLOCK = 8_192


def usable(vector: Column, dim: int) -> Column:
    """A vector of `dim` finite numbers that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.size(vector) == dim, F.lit(False)) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids on the sphere and the cluster of each row; clusters left empty take rows of the largest."""
    c = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        for at in range(0, len(x), 8192):
            own[at : at + 8192] = (x[at : at + 8192] @ c.T).argmax(1)
        counts = np.bincount(own, minlength=k)
        for e in np.flatnonzero(counts == 0):
            big = counts.argmax()
            row = rng.choice(np.flatnonzero(own == big))
            own[row], counts[big], counts[e] = e, counts[big] - 1, 1
        order = np.argsort(own, kind="stable")
        c = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts)[:-1]]))
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, own


@dataclass
class Centroids:
    """Centroids of the lists, their neighbours, the nodes at which a search enters the graph, and the blocks that long lists are cut into."""

    points: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    blocks: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, total: int, degree: int = 16, seed: int = 7) -> Centroids:
        """Two levels of k-means; the second gives each first cluster lists in proportion to its rows, so that lists are balanced.

        A list whose length, estimated from the sample, is over 2 * BLOCK is compared in blocks.
        """
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)
        lists = max(1, min(lists, len(x)))
        top = max(1, int(np.sqrt(lists)))
        centres, own = k_means(x, top, 6, rng)
        sizes = np.bincount(own, minlength=top)
        share = np.minimum(np.maximum(1, np.round(lists * sizes / len(x)).astype(int)), np.maximum(sizes, 1))
        parts = [k_means(x[own == i], int(share[i]), 6, rng)[0] for i in range(top) if sizes[i]]
        points = np.concatenate(parts)
        inner = [int((p @ centres[i]).argmax()) for p, i in zip(parts, np.flatnonzero(sizes), strict=True)]
        near = np.empty((len(points), min(degree, len(points))), dtype=np.int32)
        for at in range(0, len(points), 1024):
            near[at : at + 1024] = np.argsort(-(points[at : at + 1024] @ points.T), axis=1)[:, : near.shape[1]]
        # edges back, up to `degree` / 2 of a node, so that nodes that are nobody's neighbours are reached; where a node has
        # fewer, edges to nodes at random keep the graph together
        ends = near.ravel()
        order = np.argsort(ends, kind="stable")
        place = np.arange(len(ends)) - np.searchsorted(ends[order], ends[order])
        back = rng.integers(0, len(points), (len(points), degree // 2 + 1), dtype=np.int32)
        few = place < degree // 2
        back[ends[order][few], place[few]] = (order // near.shape[1])[few]
        heads = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]) + np.array(inner)
        index = cls(points, np.concatenate([near, back], axis=1), heads.astype(np.int32), np.ones(len(points), dtype=np.int64))
        length = np.bincount(index.lists_of(x, 4, 1.25)[1], minlength=len(points)) * (total / len(x))
        index.blocks = np.where(length > 2 * BLOCK, np.ceil(length / BLOCK), 1).astype(np.int64)
        return index

    def search(self, x: np.ndarray, pool: int, beam: int = 4, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroids, their similarity) of each row, best first: a best-first search through the graph, all rows at once.

        Each round follows the edges of the `beam` best nodes of the pool that were not followed yet.
        """
        pool = min(pool, len(self.points))
        k = min(2 * beam, len(self.entries))
        ids = self.entries[np.argpartition(-(x @ self.points[self.entries].T), k - 1, axis=1)[:, :k]].astype(np.int64)
        best, score, done = self._top(x, ids, np.zeros(ids.shape, dtype=bool), pool)
        row = np.arange(len(x))[:, None]
        for _ in range(rounds):
            step = np.argsort(done, axis=1, kind="stable")[:, :beam]  # the first that are not done, in order of similarity
            if done[row, step].all():
                break
            done[row, step] = True
            ids = np.concatenate([best, self.near[best[row, step]].reshape(len(x), -1)], axis=1)
            best, score, done = self._top(x, ids, np.concatenate([done, np.zeros((len(x), ids.shape[1] - best.shape[1]), dtype=bool)], axis=1), pool)
        return best, score

    def _top(self, x: np.ndarray, ids: np.ndarray, done: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.sort(ids * 2 + ~done, axis=1)  # of equal nodes the one that is done comes first
        ids, done = mark >> 1, (mark & 1) == 0
        sims = np.einsum("qd,qkd->qk", x, self.points[ids], optimize=True)
        again = ids[:, 1:] == ids[:, :-1]
        sims[:, 1:][again] = -2.0
        done[:, 1:][again] = True
        order = np.argsort(-sims, axis=1)[:, :pool]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), np.take_along_axis(done, order, 1)

    def lists_of(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists of each row: its nearest, and others at most `ratio` times as far, up to `most`."""
        rows, lists = [], []
        wide = max(24, 2 * most)
        for at in range(0, len(x), 1024):
            best, score = self.search(x[at : at + 1024], wide, beam=4 if most < 12 else 12, rounds=8)
            away = np.sqrt(np.maximum(2 - 2 * score, 0))
            ok = (score > -1.5) & (away <= ratio * away[:, :1] + 1e-9)
            ok[:, most:] = False
            r, c = np.nonzero(ok)
            rows.append(r + at)
            lists.append(best[r, c])
        return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(lists) if lists else np.empty(0, int)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distinct_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of the usable vectors; an id that comes more than once keeps the vector of least hash. Null ids are left out."""
    good = rows.filter(F.col(key).isNotNull() & usable(F.col(vector), dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    twice = stored(good.groupBy("id").agg(F.count("*").alias("n"), F.min(F.xxhash64("v")).alias("_h")).filter("n > 1").select("id", "_h"), "twice")
    once = good.join(twice, "id", "left_anti")
    return once.unionByName(good.join(twice, "id").filter(F.xxhash64("v") == F.col("_h")).groupBy("id").agg(F.first("v").alias("v")))


def fit_index(vectors: DataFrame, dim: int, total: int) -> Centroids:
    """Centroids for `total` vectors from a sample of at most SAMPLE of them, chosen by hash of the id."""
    rate = min(1.0, SAMPLE * 0.97 / max(total, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("v").limit(SAMPLE).toArrow()
    column = picked.column("v").combine_chunks()
    x = _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dim) if picked.num_rows else np.eye(1, dim, dtype=np.float32)
    return Centroids.fit(x, max(1, min(MOST_LISTS, total // PER_LIST)), total)


def _spread(ids: np.ndarray) -> np.ndarray:
    """A hash of each id, so that ids with a stride fill all blocks of a list."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)


def _placed(vectors: DataFrame, index: Centroids, dim: int, most: int, ratio: float) -> DataFrame:
    """(list, q, m, role, id, v): each vector of (id, v, role) in its lists; role 1 asks, 2 is a member, 3 both.

    A list cut into n blocks becomes n * n cells: a query of block i goes to the cells (i, ·), a member of block j to
    the cells (·, j). The index, of at most MOST_LISTS centroids, is sent to the tasks.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, role = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            rows, lists = sent.value.lists_of(unit(_matrix(b.column(1), dim)).astype(np.float32), most, ratio)
            n = sent.value.blocks[lists]
            parts = [(rows[n == 1], lists[n == 1], np.zeros((n == 1).sum(), dtype=int), np.zeros((n == 1).sum(), dtype=int), role[rows[n == 1]])]
            for bit in (1, 2):
                long = np.flatnonzero((n > 1) & (role[rows] & bit > 0))
                k = n[long]
                again = np.repeat(long, k)
                other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                own = (_spread(ids[rows[again]]) % n[again].astype(np.uint64)).astype(np.int64)
                parts.append((rows[again], lists[again], own if bit == 1 else other, other if bit == 1 else own, np.full(len(again), bit)))
            at, list_, q, m, r = (np.concatenate(x) for x in zip(*parts, strict=True))
            picked = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (list_, q, m, r)), b.column(0).take(picked), b.column(1).take(picked)], ["list", "q", "m", "role", "id", "v"])

    return vectors.select("id", "v", F.col("role").cast("int").alias("role")).mapInArrow(run, "list int, q int, m int, role int, id long, v array<float>")


def _compare(k: int, least: float, dim: int):
    def run(table: pa.Table) -> pa.Table:
        ids, role = table.column("id").to_numpy(), table.column("role").to_numpy()
        lists = table.column("v").combine_chunks()
        x = unit(_matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, dim))
        x32 = x.astype(np.float32)
        q, m = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        m = m[np.argsort(ids[m], kind="stable")]
        a, b, s = [], [], []
        for at in range(0, len(q), 512):
            rows = q[at : at + 512]
            sims = x32[rows] @ x32[m].T
            sims[ids[rows][:, None] == ids[m][None, :]] = -2.0
            if least > -1:
                r, c = np.nonzero(sims >= least - 1e-4)
            else:
                c = np.argpartition(-sims, min(k + 5, len(m) - 1), axis=1)[:, : k + 6].ravel()
                r = np.repeat(np.arange(len(rows)), min(k + 6, len(m)))
            exact = np.einsum("ij,ij->i", x[rows[r]], x[m[c]])
            ok = (exact >= least) & (ids[rows[r]] != ids[m[c]])
            r, c, exact = r[ok], c[ok], exact[ok]
            order = np.lexsort((ids[m[c]], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r)
            top = np.arange(len(r)) - first < k
            a.append(ids[rows[r[top]]])
            b.append(ids[m[c[top]]])
            s.append(exact[top])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, dtype=t)
        return pa.table({"a": cat(a, np.int64), "b": cat(b, np.int64), "sim": cat(s, np.float64)})

    return run


def _in_lists(placed: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """(a, b, sim): within each cell the k best members of each query."""
    return placed.groupBy("list", "q", "m").applyInArrow(_compare(k, least, dim), "a long, b long, sim double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return found.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _crowds(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Vectors to index, and neighbours already known: of more than k + 1 equal vectors only the k + 1 least ids can be among anyone's first k."""
    marked = vectors.select("id", F.xxhash64("v").alias("h"))
    crowded = stored(marked.groupBy("h").count().filter(F.col("count") > k + 1).select("h"), "crowds")
    if not crowded.head(1):
        return vectors, None
    ranked = stored(grouped_rank(marked.join(crowded, "h", "left_semi"), ["h"], [F.col("id")]), "crowd")
    rest = ranked.filter(F.col("rank") > k + 1)
    heads = ranked.filter(F.col("rank") <= k).select("h", F.col("id").alias("b"))
    known = rest.join(heads, "h").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("sim"))
    return vectors.join(rest.select("id"), "id", "left_anti"), known


def nearest(rows: DataFrame, key: str, vector: str, dim: int, k: int = 10, least: float = -2.0, queries: Column | None = None, lists: int = 3, ratio: float = 1.25, probes: int | None = None, probe_ratio: float = 10.0) -> DataFrame:
    """(a, b, sim, rank): of every usable vector (or those where `queries` holds of `id`) the k most similar others, at least `least`.

    Vectors near a border stand in several lists, and a query looks into its own lists or, with `probes`, into up to
    so many, none more than `probe_ratio` times as far as its nearest. Of equal similarity the smaller id is first. Vectors that are null, of another length, not finite or all
    zero take no part; an id counts once. More than k + 1 equal vectors are answered by their least ids without the index.
    """
    vectors = stored(distinct_vectors(rows, key, vector, dim), "vectors")
    index = fit_index(vectors, dim, vectors.count())
    indexed, known = _crowds(vectors, k)
    asked = F.lit(True) if queries is None else queries
    if probes is None:
        placed = _placed(indexed.withColumn("role", F.when(asked, F.lit(3)).otherwise(F.lit(2))), index, dim, lists, ratio)
    else:
        members = _placed(indexed.withColumn("role", F.lit(2)), index, dim, lists, ratio)
        placed = members.unionByName(_placed(indexed.filter(asked).withColumn("role", F.lit(1)), index, dim, probes, probe_ratio))
    found = _in_lists(placed, k, least, dim)
    if known is not None:
        known = known if queries is None else known.withColumnRenamed("a", "id").filter(queries).withColumnRenamed("id", "a")
        found = found.unionByName(known)
    return _best(found, k)


def similar_pairs(rows: DataFrame, key: str, vector: str, dim: int, least: float, k: int = 10) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of similarity >= least, one being among the other's k most similar."""
    found = nearest(rows, key, vector, dim, k, least)
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
