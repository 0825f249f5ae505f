"""Search for many query vectors against brute force."""

import numpy as np

from grainfield.functions import vectors
from grainfield.plans import catalog, search


def test_no_query_is_dropped(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "a", [1.0, 0.0]), (2, 11, 0, "b", [1.0, 1.0])], "id long, page_id long, idx int, text string, embedding array<float>")
    pages = spark.createDataFrame([(i, f"https://h{i}.org/", "t", "l", 0.1, None, False) for i in (10, 11)], "id long, url string, title string, license_type string, pagerank double, quality double, compilable boolean")
    queries = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(1200)], "query_id long, vector array<float>")
    assert search.search(chunks, pages, queries, 2, 1).select("query_id").distinct().count() == 1200


def test_best_chunks_and_pool_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "POOL", 2)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 60)) if i % 50 else None, int(rng.integers(0, 3)), rng.integers(-2, 3, 4).astype(float).tolist() if i % 37 else None) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id long, page_id long, idx int, embedding array<float>")
    asked = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    want = {}
    for q, v in asked:
        for i, page, idx, e in rows:
            a, b = np.array(e or [0.0] * 4), np.array(v)
            sim = (a @ b) / max(np.sqrt(a @ a) * np.sqrt(b @ b), 1e-300)
            if sim > 0:
                want[q, page] = min(want.get((q, page), (9,)), (-sim, idx, i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        best = search.best_chunks(chunks, queries, 4)
        assert {(r.query_id, r.page_id): (-r.similarity, r.chunk_id) for r in best.collect()} == {k: (v[0], v[2]) for k, v in want.items()}
        got = {(r.query_id, r.page_id, r.place) for r in search.pool(search.best_chunks(chunks.filter("page_id IS NOT NULL"), queries, 4, 6), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, _ in asked:
        ordered = sorted((v[0], page) for (k, page), v in want.items() if k == q and page is not None)
        assert {(page, n) for k, page, n in got if k == q} == {(page, n) for n, (_, page) in enumerate(ordered[:6], 1)}


def test_queries_are_all_usable_chunks_divisible_by_100(spark):
    d = "/root/testdata/sf0.01"
    chunks = catalog.chunks_of(spark, d)
    want = {r.id for r in chunks.filter(search.usable(chunks.embedding, 64) & (vectors.norm(chunks.embedding) > 0) & (chunks.id % 100 == 0)).collect()}
    assert len(want) > 5 and {r.query_id for r in catalog.search_diverse(spark, d).collect()} == want
