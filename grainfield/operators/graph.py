"""Graph operators over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.session import stored


def valid_edges(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (src, dst) whose ends are both vertices (id)."""
    e = links.select(F.col("from_page_id").alias("src"), F.col("to_page_id").alias("dst")).distinct()
    return e.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


#: Links of one row of the adjacency table; more links of a vertex stand in several rows.
ROW_LINKS = 1_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, share, dsts, lead): the targets of each vertex in rows of about ROW_LINKS, one of which leads; share is 1 / out-degree."""
    wide = edges.join(out_degrees(edges), "src")
    row = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out_degree") / ROW_LINKS).cast("long"))
    rows = wide.groupBy("src", row.alias("row")).agg(F.collect_list("dst").alias("dsts"), (1.0 / F.max("out_degree")).alias("share"))
    first = rows.groupBy(F.col("src").alias("_src")).agg(F.min("row").alias("_row"))
    return rows.join(first, F.col("src") == F.col("_src")).select("src", "share", "dsts", (F.col("row") == F.col("_row")).alias("lead"))


def page_rank(vertices: DataFrame, links: DataFrame, damping: float = 0.85, steps: int = 50, block: int = 10) -> DataFrame:
    """(id, rank) after a fixed number of steps; the mass of vertices without links is spread evenly. Ranks add up to 1.

    Start, jump and spread mass are all multiples of the vector of ones, so the ranks are a combination of the flows v(j), j steps of
    passing on from ones, whose weights follow from the sums of the flows alone: the mass a flow loses at vertices without links is
    s(j) - s(j+1). So the steps need no answer from the driver; `block` of them are one job, in which the adjacency table is shuffled
    once and each step is one join and one aggregation with map-side combine. Each block's flows are written, which cuts the lineage and survives lost executors.
    An empty table has no ranks; self-links count.
    """
    ids = stored(vertices.select("id").filter("id IS NOT NULL").distinct(), "vertices")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    near = stored(adjacency(valid_edges(ids, links)), "adjacency")
    kind = "array<struct<id:bigint,got:double,vs:array<double>>>"
    flow, sums, written = ids.withColumn("vs", F.array(F.lit(1.0))), [float(n)], []
    while len(sums) <= steps:
        k = min(block, steps + 1 - len(sums))
        for _ in range(k):
            own = F.when(F.coalesce("lead", F.lit(True)), F.array(F.struct(F.col("id"), F.lit(0.0).alias("got"), F.col("vs")))).otherwise(F.array().cast(kind))
            last = F.element_at("vs", -1) * F.col("share")
            passed = F.transform("dsts", lambda x: F.struct(x.alias("id"), last.alias("got"), F.lit(None).cast("array<double>").alias("vs")))  # noqa: B023
            told = flow.join(near, F.col("id") == F.col("src"), "left").select(F.explode(F.concat(own, F.coalesce(passed, F.array().cast(kind)))).alias("x")).select("x.*")
            flow = told.groupBy("id").agg(F.sum("got").alias("got"), F.max("vs").alias("vs")).select("id", F.concat("vs", F.array("got")).alias("vs"))
        table = stored(flow, "flows")
        got = table.agg(*[F.sum(F.col("vs")[i + 1]) for i in range(k)]).first()
        written.append((len(sums), k, table))
        sums += list(got)
        flow = table.select("id", F.array(F.element_at("vs", -1)).alias("vs"))
    weights = [1.0 / n]
    for _ in range(steps):
        lost = sum(w * (sums[j] - sums[j + 1]) for j, w in enumerate(weights))
        weights = [(1 - damping) / n + damping * lost / n] + [damping * w for w in weights]
    parts = ids.select("id", F.lit(weights[0]).alias("rank"))
    for at, k, table in written:
        parts = parts.unionByName(table.select("id", sum(F.col("vs")[i + 1] * weights[at + i] for i in range(k)).alias("rank")))
    return parts.groupBy("id").agg(F.sum("rank").alias("rank"))


def links_to_pages(found: DataFrame, pages: DataFrame, keep_self: bool = True, order: str | None = None) -> DataFrame:
    """(from_page_id, to_page_id, anchor_text) of links (page_id, href, anchor) whose target is a page; one row an edge.

    Of several links of one edge the anchor of the first by the column `order` stays, without it the least.
    """
    at = F.col(order) if order else F.col("anchor")
    edges = found.select(F.col("page_id").alias("from_page_id"), "href", F.col("anchor").alias("anchor_text"), at.alias("_at")).join(pages.select(F.col("id").alias("to_page_id"), F.col("url").alias("href")), "href")
    edges = edges if keep_self else edges.filter("from_page_id <> to_page_id")
    return edges.groupBy("from_page_id", "to_page_id").agg(F.min_by("anchor_text", F.struct("_at", "anchor_text")).alias("anchor_text"))


def links_to_frontier(found: DataFrame, pages: DataFrame, depth: int = 0) -> DataFrame:
    """(url, inbound, depth) of link targets (page_id, href) that are no page yet; blank ones are left out."""
    new = found.filter(F.coalesce("href", F.lit("")) != "").join(pages.select(F.col("url").alias("_url")).distinct(), F.col("href") == F.col("_url"), "left_anti")
    return new.groupBy(F.col("href").alias("url")).agg(F.count("*").alias("inbound")).withColumn("depth", F.lit(depth))


def breadth_first(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, depth): vertices that are at most `most` steps from a seed (id), with their least number of steps.

    A step joins the newest level with the edges and takes out what was reached; levels are written, so lineage stays short. It ends when a level is empty.
    """
    reached = stored(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    level = reached
    for depth in range(1, most + 1):
        beyond = edges.join(level.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        level = stored(beyond.join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached
