"""Semantic search as one DataFrame job: score, best chunk of each page, pool, diverse pick, hydrate."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions import texts, urls, vectors
from grainfield.session import stored

#: Pool size in results, similarity added between results of one site, weight of relevance in a pick.
POOL, SAME_SITE, RELEVANCE = 5, 0.3, 0.7
#: Queries of one broadcast and pass, and of those so many held against the chunks of a batch at once.
BLOCK, TILE = 2_048, 16


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite numbers."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by page in tables that part no page, with the first row of each page."""
    left: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        page = t.column("page_id")
        value, null = page.fill_null(0).to_numpy(), page.is_null().to_numpy()
        return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*left, b]).combine_chunks()
        at = starts(t)
        if at[-1]:
            yield t.slice(0, int(at[-1])).combine_chunks(), at[:-1]
        left = t.slice(int(at[-1])).combine_chunks().to_batches()
    if left:
        t = pa.Table.from_batches(left).combine_chunks()
        yield t, starts(t)


def _lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1])
    for row in x:
        total += row * row
    return np.sqrt(total)


def _best_of_pages(sent: Broadcast, dim: int, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        q_length, floor = _lengths(q), np.zeros(len(ids))
        for t, heads in _whole_pages(batches):
            x = np.ascontiguousarray(t.column("embedding").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim).T)
            length, sizes, rows = _lengths(x), np.diff(heads, append=t.num_rows), np.arange(t.num_rows)
            pages, chunks = t.column("page_id").combine_chunks(), t.column("id").combine_chunks()
            for a in range(0, len(ids), TILE):
                part = q[:, a : a + TILE]
                # sums in the order of the numbers, as `vectors.dot` has them, so that equal vectors are equally similar
                sim, product = np.zeros((part.shape[1], t.num_rows)), np.empty((part.shape[1], t.num_rows))
                for i in range(dim):
                    sim += np.multiply(part[i][:, None], x[i][None, :], out=product)
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim /= q_length[a : a + TILE, None] * length[None, :]
                sim[~(sim > 0)] = 0
                best = np.maximum.reduceat(sim, heads, axis=1)
                if most is not None and len(heads) > most:
                    nth = np.partition(best, len(heads) - most, axis=1)[:, len(heads) - most]
                    floor[a : a + TILE] = np.maximum(floor[a : a + TILE], nth)
                k, p = np.nonzero((best > 0) & (best >= floor[a : a + TILE, None]))
                first = np.minimum.reduceat(np.where(sim == np.repeat(best, sizes, axis=1), rows, t.num_rows), heads, axis=1)
                chosen = pa.array(first[k, p])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + k]), pages.take(chosen), chunks.take(chosen), pa.array(best[k, p])], ["query_id", "page_id", "chunk_id", "similarity"])

    return run


def best_chunks(chunks: DataFrame, queries: DataFrame, dim: int, most: int | None = None) -> DataFrame:
    """(query_id, page_id, chunk_id, similarity): for each query the best chunk of every page, of positive cosine similarity; of equal ones the first.

    `queries` (query_id, vector) may be many: they are sent in blocks of BLOCK, each with a pass of its own over the chunks, which
    are brought together by page, so that only results leave a task. With `most`, pages that can't be among so many
    of a query are left out where they are found; all pages that tie stay, so `pool` decides among them.
    """
    spark = chunks.sparkSession
    good = chunks.filter(usable(F.col("embedding"), dim)).select("page_id", "idx", "id", "embedding")
    parts = good.repartition("page_id").sortWithinPartitions("page_id", "idx", "id")
    rows = queries.filter(usable(F.col("vector"), dim)).select("query_id", vectors.doubles(F.col("vector")).alias("vector")).toLocalIterator()
    fields = "query_id long, page_id long, chunk_id long, similarity double"
    found = spark.createDataFrame([], fields)
    for n, block in enumerate(iter(lambda: list(islice(rows, BLOCK)), [])):
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in block], dtype=np.int64), np.array([r.vector for r in block]).T.copy()))
        own = parts.mapInArrow(_best_of_pages(sent, dim, most), fields)
        found = found.unionByName(own) if n else own
    return found


def pool(best: DataFrame, k: int) -> DataFrame:
    """The POOL * k most similar pages of each query; ties by page id."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "page_id")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= POOL * k)


def diverse_pick(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Greedy choice of k rows: similarity times (RELEVANCE + rest * (1 - closeness to what is chosen)); of equal gain the earlier row."""
    rows = rows.sort_values("place")
    if len(rows) <= k or k <= 0:
        return rows.assign(pick=range(1, len(rows) + 1))
    x = np.stack([np.asarray(v, dtype=float) for v in rows["embedding"]])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    sim, site = rows["similarity"].to_numpy(), rows["domain"].fillna("").to_numpy()
    nearest, chosen = np.zeros(len(rows)), []
    free = np.ones(len(rows), dtype=bool)
    for _ in range(k):
        gain = np.where(free, sim * (RELEVANCE + (1 - RELEVANCE) * (1 - nearest)), -np.inf)
        i = int(gain.argmax())
        chosen.append(i)
        free[i] = False
        near = x @ x[i]
        same = (site == site[i]) & (site != "")
        near = np.where(same, np.minimum(1.0, near + SAME_SITE), near)
        nearest = np.maximum(nearest, near)
    return rows.iloc[chosen].assign(pick=range(1, k + 1))


def _picked(few: DataFrame, vectors_: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """(query_id, page_id, chunk_id, similarity, pick): the diverse choice among the pool, whose vectors are (chunk_id, embedding)."""
    slim = pages.select(F.col("id").alias("page_id"), urls.display_domain(F.col("url")).alias("domain"))
    placed = few.join(slim, "page_id").join(vectors_, "chunk_id").select("query_id", "page_id", "chunk_id", "similarity", "place", "domain", "embedding")
    fields = "query_id long, page_id long, chunk_id long, similarity double, pick int"
    return placed.groupBy("query_id").applyInPandas(lambda r: diverse_pick(r, k)[["query_id", "page_id", "chunk_id", "similarity", "pick"]], fields)


def _shown(picked: DataFrame, text: DataFrame, pages: DataFrame) -> DataFrame:
    """The results with all that is shown of them; `text` has (chunk_id, snippet)."""
    n = pages.agg(F.count("*").cast("double").alias("n_pages"))
    shown = picked.join(pages.select(F.col("id").alias("page_id"), "url", "title", "license_type", "pagerank", "quality", "compilable"), "page_id")
    score = vectors.final_score(F.col("similarity"), F.col("pagerank"), F.col("n_pages"), F.col("quality"), F.col("compilable"))
    return shown.crossJoin(F.broadcast(n)).join(text, "chunk_id").select("query_id", "pick", "page_id", "chunk_id", "similarity", score.alias("final_score"), "url", "title", "snippet", "license_type", "compilable")


def search(chunks: DataFrame, pages: DataFrame, queries: DataFrame, dim: int, k: int = 20) -> DataFrame:
    """(query_id, pick, page_id, chunk_id, similarity, final_score, url, title, snippet, license_type, compilable) of the k results of each query.

    Only the pool, POOL * k rows a query, is joined with the pages and passes through Python; texts are fetched last.
    """
    few = pool(best_chunks(chunks, queries, dim, POOL * k), k)
    picked = _picked(few, chunks.select(F.col("id").alias("chunk_id"), "embedding"), pages, k)
    return _shown(picked, chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("snippet")), pages)


def page_pool(page_vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, page_id, chunk_id, similarity, place): the POOL * k pages whose own vectors (page_id, centroid) are most similar; chunk_id is the page's id."""
    own = page_vectors.select("page_id", F.lit(0).alias("idx"), F.col("page_id").alias("id"), F.col("centroid").alias("embedding")).filter(vectors.norm(F.col("embedding")) > 0)
    return pool(best_chunks(own, queries, dim, POOL * k), k)


def request(chunks: DataFrame, pages: DataFrame, queries: DataFrame, dim: int, k: int = 20, compilable_only: bool = False) -> DataFrame:
    """The results of `search`, for queries without any those of the pages' own vectors, with `total`, the number of results of each query.

    `compilable_only` takes out other results after the k were chosen, so fewer may be left. Page results have no chunk_id; their snippet is the page's.
    """
    first = stored(search(chunks, pages, queries, dim, k), "found")
    bare = stored(queries.join(first.select("query_id").distinct(), "query_id", "left_anti"), "unanswered")
    found = first
    if not bare.isEmpty():
        centres = stored(vectors.centroids(chunks.filter(usable(F.col("embedding"), dim)), "page_id", "embedding", dim), "centroids")
        picked = _picked(page_pool(centres, bare, dim, k), centres.select(F.col("page_id").alias("chunk_id"), F.col("centroid").alias("embedding")), pages, k)
        shown = _shown(picked, pages.select(F.col("id").alias("chunk_id"), texts.snippet(F.col("text_content")).alias("snippet")), pages)
        found = first.unionByName(shown.withColumn("chunk_id", F.lit(None).cast("long")))
    found = found.filter("compilable") if compilable_only else found
    return found.withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
