"""Changes of keyed tables as functions from tables to a new table: upsert, delete, merge, queues, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_schema(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that are missing, with their defaults; a table that has them is unchanged."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def least_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is least by `order` (ascending, nulls first); partial aggregation combines hot keys map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c not in keys]).select(*df.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of `table` replaced by those of `rows` with the same key, except the columns to keep; other rows of both unchanged.

    `rows` has one row a key.
    """
    new = rows.select(*[F.col(c).alias(f"_new_{c}") for c in rows.columns])
    both = table.join(new, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    there, fresh = F.col(key).isNotNull(), F.col(f"_new_{key}").isNotNull()
    cols = [F.when(fresh & (F.lit(c not in keep) | ~there), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in table.columns]
    return both.select(*cols)


def set_columns(table: DataFrame, changes: DataFrame, key: str, nulls: bool = False) -> DataFrame:
    """Columns of `changes` where they are not null, or with `nulls` as they are, by key; other rows unchanged."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    return table.join(new, F.col(key) == F.col("_key"), "left").select(
        *[(F.when(F.col("_key").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_new_{c}", c)).alias(c) if c in cols else F.col(c) for c in table.columns]
    )


def delete_cascade(gone: DataFrame, pages: DataFrame, chunks: DataFrame, links: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the pages whose id is in `gone`, and without what belongs to them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    drop = lambda df, c: df.join(ids, F.col(c) == F.col("_gone"), "left_anti")
    return {"pages": drop(pages, "id"), "chunks": drop(chunks, "page_id"), "links": drop(drop(links, "from_page_id"), "to_page_id"), "quality_reviews": drop(reviews, "page_id")}


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """The rows of each parent named in `rows` replaced by those of `rows`."""
    ids = rows.select(F.col(parent).alias("_p")).distinct()
    return table.join(ids, F.col(parent) == F.col("_p"), "left_anti").unionByName(rows)


def claim(queue: DataFrame, order: Sequence[Column], n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(the first n rows, the rest) of a queue; the order must be total."""
    taken = queue.orderBy(*order).limit(n)
    return taken, queue.join(taken.select(key), key, "left_anti")


def sightings(urls: DataFrame, url: Column) -> DataFrame:
    """(url, inbound): how often each normalised URL was seen; blank ones are left out."""
    return urls.select(url.alias("url")).filter("url <> ''").groupBy("url").agg(F.count("*").alias("inbound"))


def top_of_frontier(frontier: DataFrame, n: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """The n rows of highest priority ln(1 + inbound), with noise up to a part of it, among the max(3n, 100) of most inbound links.

    Both limits are of fixed size; ties by URL.
    """
    most = frontier.orderBy(F.desc("inbound"), "url").limit(max(3 * n, 100))
    priority = F.log1p("inbound") * (1 + noise * F.rand(seed)) if noise else F.log1p("inbound")
    return most.withColumn("priority", priority).orderBy(F.desc("priority"), "url").limit(n)


def prune_frontier(frontier: DataFrame, known: DataFrame, unwanted: Column) -> DataFrame:
    """(url, reason) of the entries to remove: already a page, no http address, or unwanted."""
    marked = frontier.join(known.select(F.col("url").alias("_known")).distinct(), F.col("url") == F.col("_known"), "left")
    reason = F.when(F.col("_known").isNotNull(), "indexed").when(~F.lower("url").rlike("^https?://"), "not http").when(unwanted, "unwanted")
    return marked.select("url", reason.alias("reason")).filter("reason IS NOT NULL")


def first_texts(chunks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Chunks whose text comes first in the corpus, by page and place; texts already `seen` are left out, places keep their gaps.

    Hashes of texts are grouped, with partial aggregation, and the least place joined back by chunk id.
    """
    marked = chunks.select(F.col("id"), F.struct("page_id", "idx", "id").alias("at"), F.sha2("text", 256).alias("h"))
    first = marked.groupBy("h").agg(F.min("at").alias("_at"))
    if seen is not None:
        first = first.join(seen.select(F.sha2("text", 256).alias("h")).distinct(), "h", "left_anti")
    return chunks.join(first.select(F.col("_at.id").alias("id")), "id", "left_semi")


def grown_enough(n_then: Column, n_now: Column, least: int = 10, factor: float = 1.05) -> Column:
    """Whether ranks are due again: enough pages then, and so many more now."""
    return (n_then >= least) & (n_now > factor * n_then)


def checked_batch(rows: DataFrame, problem: Column, most: int = 100) -> DataFrame:
    """The rows of a small batch if it has 1 to `most` rows and none has a problem; else an error for the whole batch."""
    n, bad = rows.select(problem.alias("bad")).agg(F.count("*"), F.count_if("bad")).first()
    if not 1 <= n <= most or bad:
        raise ValueError(f"batch of {n} rows, {bad} of them bad; at most {most}, none bad")
    return rows


def canonical_winners(pages: DataFrame, canon: Column, is_www: Column, size: str) -> DataFrame:
    """Of pages with one canonical URL the one with most chunks, then not under www., then of least id: (id, canonical, n_merged, is_winner).

    The window covers the spellings of one URL, which are few.
    """
    marked = pages.withColumn("canonical", canon).withColumn("_www", is_www)
    w = Window.partitionBy("canonical").orderBy(F.col(size).desc(), F.col("_www").asc(), F.col("id").asc())
    n = F.count("*").over(Window.partitionBy("canonical"))
    return marked.select("id", "canonical", n.alias("n_merged"), (F.row_number().over(w) == 1).alias("is_winner"))
