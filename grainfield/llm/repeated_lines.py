"""Problem 6: lines and blocks of lines that recur over the pages of one site, by suffix arrays over line identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.session import stored


def line_keys(text: Column) -> Column:
    """For each line of a text an identifier of its letters in order, ignoring case; 0 for lines without letters.

    The identifier has 64 bits: lines that differ share one about once in 10^19 pairs.
    """
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.when(letters(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(letters(x))))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of an integer sequence in order, by prefix doubling; also the ranks of the prefixes of 1, 2, 4 ... lines."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while len(ids) and rank.max() + 1 < len(ids) and step < len(ids):
        second = np.full(len(ids), -1, dtype=np.int64)
        second[:-step] = rank[step:]
        rank = np.unique((rank + 1) * (len(ids) + 2) + second + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, by descending through the levels."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = a + out[1:], b + out[1:]
        fits = (x + step <= n) & (y + step <= n)
        fits[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        out[1:] += step * fits
    return out


def _block_counts(min_len: int, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        site_names = t.column("site").combine_chunks().dictionary_encode()
        if isinstance(site_names, pa.ChunkedArray):
            site_names = site_names.combine_chunks()
        site_of_doc = site_names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = t.column("keys").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        wanted = t.column("wanted").combine_chunks()
        if isinstance(wanted, pa.ChunkedArray):
            wanted = wanted.chunk(0)
        hot = np.ones(len(values), dtype=bool) if wanted.null_count else wanted.flatten().to_numpy(zero_copy_only=False)
        real = values != 0
        values, docs, hot = values[real], docs[real], hot[real]
        if not len(values):
            return
        # the same letters on two sites are two identifiers; each page ends in a mark of its own
        order = np.lexsort((values, site_of_doc[docs]))
        sv, ss = values[order], site_of_doc[docs][order]
        new = np.concatenate([[True], (sv[1:] != sv[:-1]) | (ss[1:] != ss[:-1])])
        ids = np.empty(len(values), dtype=np.int64)
        ids[order] = np.cumsum(new) - 1
        ends = np.flatnonzero(np.concatenate([docs[1:] != docs[:-1], [True]])) + 1
        seq = np.insert(ids, ends, ids.max() + 1 + np.arange(len(ends)))
        doc_at = np.insert(docs, ends, -1)
        value_at = np.insert(values, ends, 0)
        # for each place the wanted lines from there on without a break; a mark is none
        place = np.arange(len(seq))
        stop = np.where(np.insert(hot, ends, False), len(seq), place)
        run_of = np.minimum.accumulate(stop[::-1])[::-1] - place
        sa, levels = suffix_array(seq)
        lcp = common_prefixes(sa, levels)
        follow = np.append(value_at, 0)
        for size in range(min_len, max_len + 1):
            first = np.concatenate([[True], lcp[1:] < size])
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            fits = run_of[sa] >= size
            if not fits.any():
                break
            pair = np.unique(group[fits] * (t.num_rows + 1) + doc_at[sa][fits])
            docs_of = np.bincount(pair // (t.num_rows + 1), minlength=len(starts))
            places = np.diff(starts, append=len(sa))
            # the line that follows, 0 where the page ends
            after = follow[np.minimum(sa + size, len(seq))]
            low, high = np.minimum.reduceat(after, starts), np.maximum.reduceat(after, starts)
            ended = np.maximum.reduceat(after == 0, starts)
            keep = fits[starts]
            heads = sa[starts[keep]]
            key = np.zeros(len(heads), dtype=np.uint64)
            for i in range(size):
                key = key * np.uint64(1_000_003) + value_at[heads + i].view(np.uint64)
            columns = [key.view(np.int64), np.full(len(heads), size, dtype=np.int32), docs_of[keep].astype(np.int64), value_at[heads], places[keep].astype(np.int64), low[keep], high[keep], ended[keep]]
            site = pa.DictionaryArray.from_arrays(pa.array(site_of_doc[doc_at[heads]].astype(np.int32)), site_names.dictionary).cast(pa.string())
            yield pa.RecordBatch.from_arrays([site, *map(pa.array, columns)], ["site", "block", "n_lines", "n_docs", "first_line", "places", "low", "high", "ended"])

    return run


def _counted(pages: DataFrame, min_docs: int, min_len: int, max_len: int) -> DataFrame:
    """Blocks of wanted lines, all where `wanted` is null, with their exact numbers of pages, as far as those suffice."""
    parts = pages.select("site", "id", "keys", "wanted").repartitionByRange("site", "id").sortWithinPartitions("site", "id").select("site", "keys", "wanted")
    counted = parts.mapInArrow(_block_counts(min_len, max_len), "site string, block long, n_lines int, n_docs long, first_line long, places long, low long, high long, ended boolean")
    sums = [F.sum("n_docs").alias("n_docs"), F.min("first_line").alias("first_line"), F.sum("places").alias("places"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("ended").alias("ended")]
    return counted.groupBy("site", "block", "n_lines").agg(*sums).filter(F.col("n_docs") >= min_docs)


def recurring_blocks(pages: DataFrame, min_docs: int = 5, min_share: float = 0.2, min_len: int = 1, max_len: int = 1) -> DataFrame:
    """Blocks of min_len to max_len lines that stand on at least min_docs pages and min_share of the pages of their site.

    `pages` has (site, id, keys), keys from `line_keys`, one row a page. Pages are range-partitioned by
    site and id, so that small sites stay whole and a hot site is split over many tasks. In each
    part one suffix array covers the concatenated line identifiers, and the common prefixes of
    neighbouring suffixes give the blocks of each length with their number of pages, those that stand in the part
    once included; parts hold different pages, so counts add up. Blocks of two lines and more are made of lines that
    recur themselves, for each line of a block stands on at least as many pages; other lines end a block. Of
    them are given those at two places or more that are not always followed by one and the same line, and all of max_len lines.
    Columns: site, block, n_lines, n_docs, first_line, site_docs.
    """
    sites = pages.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("site_docs"))

    def enough(total: DataFrame) -> DataFrame:
        return total.join(sites, F.col("site") == F.col("_site")).filter(F.col("n_docs") >= min_share * F.col("site_docs") - 1e-9).drop("_site")

    columns = ["site", "block", "n_lines", "n_docs", "first_line", "site_docs"]
    every = pages.withColumn("wanted", F.lit(None).cast("array<boolean>"))
    single = enough(_counted(every, min_docs, 1, 1))
    if max_len <= 1:
        return single.select(*columns)
    single = stored(single.select(*columns), "recurring")
    lines = single.groupBy("site").agg(F.collect_set("first_line").alias("_lines"))
    some = pages.join(lines, "site").withColumn("wanted", F.transform("keys", lambda x: F.array_contains("_lines", x)))
    blocks = enough(_counted(some, min_docs, max(2, min_len), max_len))
    branching = (F.col("places") > 1) & (F.col("ended") | (F.col("low") != F.col("high")) | (F.col("n_lines") == max_len))
    blocks = blocks.filter(branching).select(*columns)
    return single.unionByName(blocks) if min_len <= 1 else blocks


def keyed_pages(pages: DataFrame, site: Column, key: str = "id", text: str = "text_content") -> DataFrame:
    """(site, id, keys) of each page, written once; null and empty texts have a single line without letters."""
    return stored(pages.select(F.coalesce(site, F.lit("")).alias("site"), F.col(key).alias("id"), line_keys(F.col(text)).alias("keys")), "lines")


def repeated_lines(keyed: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(id, line_no) of the lines to delete: those inside a block that recurs over its site.

    With blocks from one line up, a longer block deletes no line that its single lines don't delete, for
    each of them stands on at least as many pages; so the blocks of one line decide.
    """
    found = stored(recurring_blocks(keyed, min_docs, min_share).select("site", "block"), "recurring")
    lines = keyed.select("site", "id", F.posexplode("keys").alias("pos", "block")).filter("block != 0")
    return lines.join(found, ["site", "block"], "left_semi").select("id", (F.col("pos") + 1).cast("int").alias("line_no"))


def without_lines(pages: DataFrame, removed: DataFrame, key: str = "id", text: str = "text_content") -> DataFrame:
    """The pages with the removed lines taken out of their texts; other pages are unchanged."""
    gone = removed.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.col("line_no") - 1).alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return pages.join(gone, F.col(key) == F.col("_id"), "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_id", "_gone")
