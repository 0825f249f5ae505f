"""Jobs over the whole store: content updates, merges, queues, frontier and progress, each a function from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.functions import texts, urls, vectors
from grainfield.operators import tables
from grainfield.session import stored


def lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, id): each wanted URL once, with the least id of the pages that have it, or null."""
    ids = pages.groupBy(F.col("url").alias("_url")).agg(F.min("id").alias("id"))
    return wanted.select("url").filter("url IS NOT NULL").distinct().join(ids, F.col("url") == F.col("_url"), "left").select("url", "id")


def url_known(wanted: DataFrame, pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """(url, known): whether a URL is a page or waits in the frontier already; one union and one join."""
    known = pages.select(F.col("url").alias("_url")).unionByName(frontier.select(F.col("url").alias("_url"))).distinct()
    return wanted.select("url").distinct().join(known, F.col("url") == F.col("_url"), "left").select("url", F.col("_url").isNotNull().alias("known"))


def update_content(pages: DataFrame, chunks: DataFrame, changes: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(pages, chunks) after new texts (id, text_content) of some pages: hash anew, failures 0, chunks cut anew without vectors.

    New chunk ids are hashes of page and place, above `next_id`. A null text is an empty one and leaves no chunks. Pages that are not named are unchanged; an unknown id changes nothing.
    """
    new = changes.select(F.col("id").alias("_id"), F.coalesce("text_content", F.lit("")).alias("_text"))
    named = F.col("_id").isNotNull()
    set_ = {"text_content": F.col("_text"), "content_hash": texts.content_hash(F.col("_text")), "consecutive_failures": F.lit(0)}
    both = pages.join(new, F.col("id") == F.col("_id"), "left")
    updated = both.select(*[F.when(named, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in pages.columns])
    known = new.join(pages.select("id"), F.col("_id") == F.col("id"), "left_semi")
    fresh = known.select(F.col("_id").alias("page_id"), F.posexplode(texts.paragraphs(F.col("_text"))).alias("idx", "text"))
    fresh = fresh.select((F.lit(next_id) + F.pmod(F.xxhash64("page_id", "idx"), F.lit(1 << 52))).alias("id"), "page_id", F.col("idx").cast("int").alias("idx"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    kept = chunks.join(known.select(F.col("_id")), F.col("page_id") == F.col("_id"), "left_anti").select("id", "page_id", "idx", "text", "embedding")
    return updated, kept.unionByName(fresh)


def count_failures(pages: DataFrame, failed: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Pages with one failure more and validated now where their id is in `failed`; `gone` tells those that reached `most`."""
    ids = failed.select(F.col("id").alias("_id")).distinct()
    hit = F.col("_id").isNotNull()
    n = F.coalesce("consecutive_failures", F.lit(0)) + F.when(hit, 1).otherwise(0)
    both = pages.join(ids, F.col("id") == F.col("_id"), "left")
    cols = {"consecutive_failures": n, "last_validated": F.when(hit, now).otherwise(F.col("last_validated"))}
    return both.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in pages.columns], (hit & (n >= most)).alias("gone"))


def merge_www(pages: DataFrame, chunks: DataFrame, links: DataFrame, reviews: DataFrame, canon: Column, is_www: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): pages that differ by www. made one, with the canonical URL; what belongs to the others is dropped.

    The one with most chunks stays, then the one without www., then the least id. A www. page without a sibling is renamed. Report: (merged, renamed).
    """
    sizes = chunks.groupBy(F.col("page_id").alias("_p")).agg(F.count("*").alias("_n_chunks"))
    sized = pages.join(sizes, F.col("id") == F.col("_p"), "left").withColumn("_n_chunks", F.coalesce("_n_chunks", F.lit(0)))
    placed = stored(tables.canonical_winners(sized, canon, is_www, "_n_chunks").join(pages.select(F.col("id").alias("_id"), F.col("url").alias("_url")), F.col("id") == F.col("_id")).drop("_id"), "winners")
    kept = tables.delete_cascade(placed.filter("NOT is_winner").select("id"), pages, chunks, links, reviews)
    names = placed.filter("is_winner").select(F.col("id").alias("_id"), F.when((F.col("n_merged") > 1) | is_www_url(F.col("_url")), F.col("canonical")).otherwise(F.col("_url")).alias("_new"))
    kept["pages"] = kept["pages"].join(names, F.col("id") == F.col("_id")).select(*[F.col("_new").alias("url") if c == "url" else F.col(c) for c in pages.columns])
    report = placed.agg(F.count_if(~F.col("is_winner")).alias("merged"), F.count_if(F.col("is_winner") & (F.col("n_merged") == 1) & is_www_url(F.col("_url"))).alias("renamed"))
    return kept, report


def is_www_url(url: Column) -> Column:
    return F.lower(urls.host(url)).startswith("www.")


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows at random but the same for a seed: those of least MD5 of key and seed; a top-n, so nothing is shuffled."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def review_queue(pages: DataFrame, reviews: DataFrame, n: int, most_bytes: int = 2000, seed: int = 1) -> DataFrame:
    """(id, url, title, excerpt): so many pages without a review, at random."""
    bare = pages.join(reviews.select(F.col("page_id").alias("_p")), F.col("id") == F.col("_p"), "left_anti")
    return sample_n(bare, "id", n, seed).select("id", "url", "title", texts.byte_prefix(F.coalesce("text_content", F.lit("")), most_bytes).alias("excerpt"))


def embed_queue(chunks: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """(page_id, idx, text): the first n chunks without a vector; if there is none, the chunks of the first n pages that were never cut."""
    waiting = chunks.filter(~vectors.present(F.col("embedding"))).select("page_id", "idx", "text")
    uncut = pages.join(chunks.select(F.col("page_id").alias("_p")), F.col("id") == F.col("_p"), "left_anti").orderBy("id").limit(n)
    fresh = uncut.select(F.col("id").alias("page_id"), F.posexplode(texts.paragraphs(F.col("text_content"))).alias("idx", "text"))
    first = waiting.orderBy("page_id", "idx").limit(n)
    none = first.agg((F.count("*") == 0).alias("_none"))
    return first.unionByName(fresh.crossJoin(F.broadcast(none)).filter("_none").select("page_id", F.col("idx").cast("int").alias("idx"), "text"))


def submit_vectors(chunks: DataFrame, batch: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, page vectors) after vectors (id, embedding) came in: set by chunk id, and a vector for every page whose chunks all have one."""
    after = tables.set_columns(chunks, batch.select("id", "embedding"), "id")
    complete = after.groupBy("page_id").agg(F.bool_and(vectors.present(F.col("embedding"))).alias("_all")).filter("_all").select(F.col("page_id").alias("_p"))
    return after, vectors.centroids(after.join(complete, F.col("page_id") == F.col("_p"), "left_semi"), "page_id", "embedding", dim)


def lacking_vectors(pages: DataFrame, page_vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages without a vector of their own that have a chunk with one."""
    bare = pages.join(page_vectors.select(F.col("page_id").alias("_v")), F.col("id") == F.col("_v"), "left_anti")
    return bare.join(chunks.filter(vectors.present(F.col("embedding"))).select(F.col("page_id").alias("_p")), F.col("id") == F.col("_p"), "left_semi")


def prune_pages(pages: DataFrame, unwanted: Column, canon: Column, targets: Sequence[str] | None = None) -> DataFrame:
    """Pages to remove: unwanted, or under a URL that is not canonical; with `targets` only these URLs, whatever they are."""
    return pages.filter(F.col("url").isin(*targets) if targets is not None else unwanted | (canon != F.col("url")))


def reject(frontier: DataFrame, urls_: DataFrame) -> DataFrame:
    """The frontier without the listed URLs."""
    return frontier.join(urls_.select(F.col("url").alias("_url")).distinct(), F.col("url") == F.col("_url"), "left_anti")


def learned_domains(failing: DataFrame, known: DataFrame, exempt: Sequence[str] = ("zenodo.org",)) -> DataFrame:
    """(domain): the known domains and the failing ones, without blank ones and hosts of many tenants."""
    new = failing.select("domain").filter((F.col("domain") != "") & ~F.col("domain").isin(*exempt))
    return known.select("domain").unionByName(new).distinct()


def bloom_size(n: Column, p: Column) -> tuple[Column, Column]:
    """(bits, hashes) of a Bloom filter for n keys at a false positive rate p."""
    bits = F.ceil(-n * F.log(p) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))
    return bits, F.greatest(F.lit(1), F.round(bits / n * F.log(F.lit(2.0))).cast("int"))


def clamped(n: Column, default: int, most: int = 100) -> Column:
    """A limit asked for, or the default where it is not from 1 to `most`."""
    return F.when(n.between(1, most), n).otherwise(F.lit(default))


def domain_tier(url: Column, tiers: Sequence[Sequence[str]]) -> Column:
    """The number of the first tier that lists a URL's domain or one above it, else the number after the last."""
    name = urls.domain(url)
    out = F.lit(len(tiers) + 1)
    for k in range(len(tiers), 0, -1):
        test = F.lit(False)
        for d in tiers[k - 1]:
            test = test | (name == d) | name.endswith(f".{d}")
        out = F.when(test, k).otherwise(out)
    return out
