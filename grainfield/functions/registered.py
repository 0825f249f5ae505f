"""Functions for SQL: call `register` once a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grainfield.functions import markup


class Paragraphs:
    """Rows (idx, paragraph) of a plain text: its lines of more than so many bytes, trimmed."""

    def eval(self, text: str | None, more_than_bytes: int):
        kept = [p for x in (text or "").split("\n") if len((p := x.strip()).encode()) > more_than_bytes]
        yield from enumerate(kept)


def register(spark: SparkSession) -> None:
    """html_page(html, url) as a scalar function, paragraphs(text, bytes) as a table function, and SQL functions for domains and vectors."""
    spark.udf.register("html_page", markup.html_page)
    spark.udtf.register("paragraphs", F.udtf(Paragraphs, returnType="idx int, paragraph string"))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION url_domain(u STRING) RETURNS STRING RETURN regexp_replace(lower(regexp_extract(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1)), '^www\\.', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
