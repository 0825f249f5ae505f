"""Operators over tables, graphs, search and streams on small inputs with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainfield import sources
from grainfield.operators import graph, quality, tables
from grainfield.plans import search
from grainfield.streaming import feeds


def test_upsert_keeps_and_adds(spark):
    old = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7)], "id int, t string, rank double")
    new = spark.createDataFrame([(2, "B", 0.0), (3, "c", None)], "id int, t string, rank double")
    got = {r.id: (r.t, r["rank"]) for r in tables.upsert(old, new, "id", keep=["rank"]).collect()}
    assert got == {1: ("a", 0.5), 2: ("B", 0.7), 3: ("c", None)}
    got = {r.id: (r.t, r["rank"]) for r in tables.set_columns(old, spark.createDataFrame([(1, 0.9), (2, None)], "id int, rank double"), "id").collect()}
    assert got == {1: ("a", 0.9), 2: ("b", 0.7)}


def test_cascade_and_replace(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    chunks = spark.createDataFrame([(1, 1), (2, 2)], "id long, page_id long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "from_page_id long, to_page_id long")
    left = tables.delete_cascade(ids(2), ids(1, 2, 3), chunks, links, chunks)
    assert {k: v.count() for k, v in left.items()} == {"pages": 2, "chunks": 1, "links": 1, "quality_reviews": 1}
    fresh = spark.createDataFrame([(9, 2), (10, 2)], "id long, page_id long")
    assert sorted(r.id for r in tables.replace_children(chunks, fresh, "page_id").collect()) == [1, 9, 10]


def test_queue_schema_and_winners(spark):
    q = spark.createDataFrame([(i, i % 3) for i in range(7)], "id int, p int")
    taken, rest = tables.claim(q, [F.col("p").desc(), F.col("id")], 3, "id")
    assert [r.id for r in taken.orderBy("id").collect()] == [1, 2, 5] and rest.count() == 4
    assert tables.with_schema(q, {"p": F.lit(9), "new": F.lit(1.0)}).columns == ["id", "p", "new"]
    pages = spark.createDataFrame([(1, "u", True, 3), (2, "u", False, 3), (3, "v", True, 0)], "id int, c string, w boolean, n int")
    got = {r.id: (r.n_merged, r.is_winner) for r in tables.canonical_winners(pages, F.col("c"), F.col("w"), "n").collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (1, True)}
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 5, "n")], "k int, o int, x string")
    assert {(r.k, r.x) for r in tables.least_row_per_key(rows, ["k"], ["o"]).collect()} == {(1, "a"), (None, "n")}


def test_page_rank_against_power_iteration(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != 11}
    links = spark.createDataFrame([*edges, *list(edges)[:4], (3, 99), (98, 3)], "from_page_id long, to_page_id long")
    got = {r.id: r["rank"] for r in graph.page_rank(spark.range(12), links, steps=6).collect()}
    m, r = np.zeros((12, 12)), np.full(12, 1 / 12)
    for a, b in edges:
        m[b, a] = 1 / sum(1 for x, _ in edges if x == a)
    dangling = m.sum(0) == 0
    for _ in range(6):
        r = 0.15 / 12 + 0.85 * (m @ r + r[dangling].sum() / 12)
    assert [got[i] for i in range(12)] == pytest.approx(r.tolist()) and sum(got.values()) == pytest.approx(1)
    assert graph.page_rank(spark.range(0), links).count() == 0


def test_reviews(spark):
    rows = [(1, 7, 0.9, "a", 1), (2, 7, 0.9, "b", 1), (3, 7, 0.6, "c", 1), (4, 7, 0.1, "a", 2), (5, 8, 0.0, "a", 1), (6, 8, 2.0, "b", 1), (7, 9, None, "b", 1)]
    df = spark.createDataFrame(rows, "id long, page_id long, score double, contributor string, reviewed_at int")
    got = {r.page_id: (r.n_reviews, round(r.quality, 4)) for r in quality.geometric_quality(quality.first_reviews(df)).collect()}
    assert got == {7: (3, 0.7862), 8: (1, 0.01)}
    pages = spark.createDataFrame([(7,), (8,)], "id long")
    assert quality.coverage(pages, df, 3).collect()[0].coverage == 0.5 and quality.coverage(pages.limit(0), df, 1).collect()[0].coverage == 0.0


def test_diverse_pick():
    a, b, c = [1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]
    df = pd.DataFrame({"place": range(1, 7), "page_id": range(6), "similarity": [0.9, 0.89, 0.88, 0.87, 0.86, 0.85], "domain": [""] * 6, "embedding": [a, a, b, b, c, c]})
    assert search.diverse_pick(df, 3).page_id.tolist() == [0, 2, 4]
    two = pd.DataFrame({"place": [1, 2, 3], "page_id": [0, 1, 2], "similarity": [0.9, 0.85, 0.5], "domain": [None] * 3, "embedding": [a, a, b]})
    assert search.diverse_pick(two, 2).page_id.tolist() == [0, 1]
    tie = two.assign(similarity=[0.9, 0.88, 0.87])
    assert search.diverse_pick(tie, 2).page_id.tolist() == [0, 2]
    same = tie.assign(embedding=[a, b, c], domain=["x", "x", "y"])
    assert search.diverse_pick(same, 2).page_id.tolist() == [0, 2]
    assert search.diverse_pick(two, 5).page_id.tolist() == [0, 1, 2] and len(search.diverse_pick(two.iloc[:0], 2)) == 0


def test_search_from_end_to_end(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "a", [1.0, 0.0]), (2, 10, 1, "b", [1.0, 1.0]), (3, 11, 0, "c", [0.5, 0.1]), (4, 12, 0, "d", [-1.0, 0.0]), (5, 12, 1, "e", None), (6, 13, 0, "f", [float("nan"), 1.0])], "id long, page_id long, idx int, text string, embedding array<float>")
    pages = spark.createDataFrame([(i, f"https://h{i}.org/", "t", "l", 0.1, None, i == 11) for i in (10, 11, 12, 13)], "id long, url string, title string, license_type string, pagerank double, quality double, compilable boolean")
    got = search.search(chunks, pages, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>"), 2, 5).orderBy("pick").collect()
    assert [(r.page_id, r.snippet) for r in got] == [(10, "a"), (11, "c")]
    assert got[0].final_score == pytest.approx(1 + np.log1p(0.4)) and got[1].final_score == pytest.approx(got[1].similarity * 2 * (1 + np.log1p(0.4)))


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n a.org \n\nb.org\n")
    assert sorted(r.value for r in sources.line_list(spark, str(tmp_path / "list.txt")).collect()) == ["a.org", "b.org"]
    (tmp_path / "r.json").write_text('{"id": 1, "metadata": {"title": "x"}, "files": [{"key": "a.pdf", "size": 5}, {"key": "b.PDF", "size": 9}, {"key": "c.txt", "size": 99}, {"key": "d.pdf", "size": 99999999}]}\nnot json\n')
    got = [r.k for r in sources.records(spark, str(tmp_path / "r.json")).select(sources.largest_file(F.col("files"))["key"].alias("k")).collect()]
    assert got == ["b.PDF", None]
    v = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("null",), (None,)], "t string").select(sources.vector_of_json(F.col("t")).alias("v")).collect()
    assert [r.v for r in v] == [[1.0, 2.5], None, None, None]
    path = sources.write_version(spark.range(3), str(tmp_path / "t"), 2)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        sources.write_version(spark.range(3), str(tmp_path / "t"), 2)


def test_stream_counts_each_id_once(spark, tmp_path):
    rows = [(i, " Page" if i % 2 else "quality", "c", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(12)] + [(0, "quality", "c", "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "id long, type string, contributor string, t string").withColumn("created_at", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.windowed_counts(feeds.contribution_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM feed").first().n == 12


def test_frontier_texts_and_batches(spark):
    f = spark.createDataFrame([(f"https://x/{i}", i % 5) for i in range(20)] + [("ftp://x", 9)], "url string, inbound long")
    assert [r.url for r in tables.top_of_frontier(f, 2).collect()] == ["ftp://x", "https://x/14"]
    assert tables.top_of_frontier(f, 3, noise=0.1).count() == 3
    known = spark.createDataFrame([("https://x/1",)], "url string")
    assert {(r.url, r.reason) for r in tables.prune_frontier(f, known, F.col("url").endswith("/2")).collect()} == {("https://x/1", "indexed"), ("ftp://x", "not http"), ("https://x/2", "unwanted")}
    c = spark.createDataFrame([(1, 2, 0, "a"), (2, 1, 1, "a"), (3, 1, 0, "b"), (4, 3, 0, "c")], "id long, page_id long, idx int, text string")
    assert sorted(r.id for r in tables.first_texts(c).collect()) == [2, 3, 4]
    assert sorted(r.id for r in tables.first_texts(c, c.filter("text = 'c'").select("text")).collect()) == [2, 3]
    assert tables.checked_batch(f, F.col("inbound") > 10).count() == 21
    for bad in (F.col("inbound") > 8, F.lit(True)):
        with pytest.raises(ValueError):
            tables.checked_batch(f, bad)
    due = spark.createDataFrame([(10, 11), (10, 10), (9, 99)], "a int, b int").select(tables.grown_enough(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in due] == [True, False, False]


def test_registered_functions(spark):
    from grainfield.functions.registered import register

    register(spark)
    row = spark.sql("SELECT html_page('<title>t</title><p>x</p>', 'https://e.org').title AS t, url_domain('https://u@WWW.Ex.org:80/a') AS d, vector_dot(array(1D, 2D), array(3D, 4D)) AS v").first()
    assert (row.t, row.d, row.v) == ("t", "ex.org", 11.0)
    got = spark.sql("SELECT * FROM paragraphs(' a line that is long enough \\nshort', 10)").collect()
    assert [(r.idx, r.paragraph) for r in got] == [(0, "a line that is long enough")]
