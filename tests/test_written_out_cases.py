"""Queries over cases written out with their results, and store jobs on small tables."""

import pytest
from pyspark.sql import functions as F

from grainfield.operators import graph, store
from grainfield.plans import catalog_store as c

CASES = ["url_cases", "url_forms", "link_targets", "html_cases", "spdx_cases", "archive_records", "sitemap_seeds", "robots_gate", "fetch_gate", "json_vectors", "cut_texts", "limit_clamp", "list_file"]


@pytest.mark.parametrize("name", CASES)
def test_case_query_gives_the_results_written_out(spark, name):
    import duckdb

    got = c.QUERIES[name](spark, "")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({c.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_content_update_leaves_other_pages(spark):
    pages = spark.createDataFrame([(1, "a", "h", 2, "x"), (2, "b", None, 1, "y")], "id long, text_content string, content_hash string, consecutive_failures int, extra string")
    chunks = spark.createDataFrame([(10, 1, 0, "old", [1.0]), (11, 2, 0, "keep", [1.0])], "id long, page_id long, idx int, text string, embedding array<float>")
    changes = spark.createDataFrame([(1, "a line that is longer than twenty bytes\nno"), (9, "unknown")], "id long, text_content string")
    after, cut = store.update_content(pages, chunks, changes, 1000)
    assert {(r.id, r.consecutive_failures, r.extra) for r in after.collect()} == {(1, 0, "x"), (2, 1, "y")}
    rows = {(r.page_id, r.text, r.embedding is None) for r in cut.collect()}
    assert rows == {(2, "keep", False), (1, "a line that is longer than twenty bytes", True)}


def test_breadth_first_ends_in_a_circle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    got = graph.breadth_first(edges, spark.createDataFrame([(1,)], "id long"), 9)
    assert {(r.id, r.depth) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert graph.breadth_first(edges.limit(0), spark.createDataFrame([], "id long"), 3).count() == 0


def test_sample_is_the_same_for_a_seed(spark):
    rows = spark.range(50).select(F.col("id"))
    one, two = ({r.id for r in store.sample_n(rows, "id", 7, s).collect()} for s in (1, 2))
    assert one == {r.id for r in store.sample_n(rows, "id", 7, 1).collect()} and one != two and len(one) == 7
