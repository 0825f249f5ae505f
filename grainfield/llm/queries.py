"""The queries of the ten problems, over whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.functions.sites import site_of
from grainfield.llm import capping, contamination, encoding, main_content, near_duplicates, neighbours, rank_aggregation, reading_level, repeated_lines, scan_repair
from grainfield.operators.ranking import latest_by
from grainfield.session import load, stored


#: Folder of the public vocabulary files; GRAINFIELD_TOKENIZERS names another.
TOKENIZERS = os.environ.get("GRAINFIELD_TOKENIZERS", "/opt/tokenizers")


def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of each page id the row fetched last."""
    return latest_by(load(spark, d, "pages"), "id", "crawled_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages to drop so that no site holds more than 2 % of all distinct pages."""
    newest = F.max(F.struct(F.col("crawled_at").alias("t"), site_of(F.col("url")).alias("site"), capping.usable_quality(F.col("quality")).alias("quality"))).alias("r")
    pages = load(spark, d, "pages").groupBy("id").agg(newest).select("id", "r.site", "r.quality")
    return capping.cap_by_share(pages, "site", "quality", "id", 0.02).displaced().select("id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose sets of three-word runs overlap by at least half of their union."""
    return near_duplicates.near_duplicate_pairs(latest_pages(spark, d), "id", "text_content", width=3, t=0.5)


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class of copies and the number of near-duplicate classes: five-word runs, 0.8."""
    return near_duplicates.near_duplicate_classes(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What the repair of each submission joined, corrected and removed."""
    return scan_repair.repairs(load(spark, d, "submissions"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    """Each submission as continuous paragraphs."""
    return scan_repair.repaired(load(spark, d, "submissions")).select("submission_id", "text")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Significance of every result of each query."""
    return _significance(spark, d).select("query_id", "page_id", F.round("rho", 9).alias("rho"), F.round("mean_rank", 9).alias("mean_rank"))


def _significance(spark: SparkSession, d: str, lean: float | None = None) -> DataFrame:
    newest = F.max(F.struct(F.col("crawled_at").alias("t"), "url", "pagerank", "quality")).alias("r")
    pages = load(spark, d, "pages").groupBy("id").agg(newest).select(F.col("id").alias("page_id"), "r.url", "r.pagerank", F.when(F.col("r.quality") > 0, F.col("r.quality")).alias("quality"))
    hits = load(spark, d, "search_results").select("query_id", "url", "semantic_score").join(pages, "url")
    return rank_aggregation.robust_rank_aggregation(hits, "query_id", "page_id", ["semantic_score", "pagerank", "quality"], lean)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the most significant page over three consensus rankings of its scores."""
    return rank_aggregation.first_of_each(_significance(spark, d, lean=1.5), "query_id", "page_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of cosine similarity >= 0.9, one among the other's ten most similar."""
    return neighbours.similar_pairs(load(spark, d, "chunks"), "id", "embedding", 64, 0.9)


def p5_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 100, against all chunks."""
    found = neighbours.nearest(load(spark, d, "chunks"), "id", "embedding", 64, 10, queries=F.col("id") % 100 == 0, lists=3, probes=64, probe_ratio=1.6)
    return found.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), F.round("sim", 6).alias("similarity"), "rank")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.keyed_pages(latest_pages(spark, d), site_of(F.col("url")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur within their site."""
    return repeated_lines.repeated_lines(_lines(spark, d))


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two to eight lines that recur within their site."""
    return repeated_lines.recurring_blocks(_lines(spark, d), min_len=2, max_len=8).select("site", "block", "n_lines", "n_docs", "site_docs")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page outside its main body."""
    pages = latest_pages(spark, d).select("id", site_of(F.col("url")).alias("site"), "title", F.col("text_content").alias("text"))
    return main_content.furniture_lines(pages)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(load(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain at least half of a benchmark item."""
    return contamination.contaminated(load(spark, d, "documents"), load(spark, d, "benchmark")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without those that contain a benchmark item: what may be trained on."""
    docs = load(spark, d, "documents")
    return contamination.without_contaminated(docs, contamination.contaminated(docs, load(spark, d, "benchmark"))).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading band of each document of English prose."""
    return reading_level.reading_levels(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source stand in each reading band."""
    docs = load(spark, d, "documents").select("doc_id", "source").join(p10_found(spark, d), "doc_id")
    return docs.groupBy("source", "band").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_documents, p3_found, p3_text, p4_found, p4_ranking, p5_found, p5_knn, p6_found, p6_blocks, p7_found, p8_ids, p9_found, p9_clean, p10_found, p10_profile)}

_LATEST = "(SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC) = 1)"
_SITE = r"""regexp_replace(regexp_replace(lower(regexp_extract(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\\]*)', 1), '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1)), '\.$', ''), '^www\.', '')"""
_LINES = rf"""l AS (SELECT id, {_SITE} AS site, string_split(coalesce(text_content, ''), chr(10)) AS t FROM {_LATEST}),
      k AS (SELECT id, site, i AS line_no, regexp_replace(lower(t[i]), '[^\p{{L}}]+', '', 'g') AS key FROM (SELECT id, site, t, unnest(range(1, len(t) + 1)) AS i FROM l))"""

_VECTORS = f"""v AS (SELECT id, CAST(any_value(embedding) AS DOUBLE[]) AS v FROM chunks WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 GROUP BY id)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""
      WITH p AS (SELECT id, regexp_extract_all(lower(coalesce(text_content, '')), '[a-z0-9]+') AS w FROM {_LATEST}),
      s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
      n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.id < b.id GROUP BY 1, 2)
      SELECT id_a, id_b FROM o JOIN n x ON id_a = x.id JOIN n y ON id_b = y.id WHERE 2 * c >= x.n + y.n - c""",
    "p2_documents": """
      WITH p AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
      c AS (SELECT id, w, CASE WHEN len(w) > 0 THEN min(id) OVER (PARTITION BY w) ELSE id END AS class_id FROM p),
      s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM c WHERE id = class_id)),
      n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      o AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.id <> b.id GROUP BY 1, 2),
      l AS (SELECT a, count(*) AS n_links FROM o JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9 GROUP BY a)
      SELECT id AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l ON class_id = a""",
    "p5_found": f"""
      WITH {_VECTORS}, s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM v a, v b WHERE a.id <> b.id),
      t AS (SELECT a, b FROM s WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10)
      SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t""",
    "p5_knn": f"""
      WITH {_VECTORS}, s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM v a, v b WHERE a.id <> b.id AND a.id % 100 = 0)
      SELECT a AS id, b AS neighbour, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "p1_found": f"""
      WITH p AS (SELECT id, {_SITE} AS site, CASE WHEN quality > 0 AND NOT isnan(quality) THEN quality ELSE 0 END AS q FROM {_LATEST}),
      r AS (SELECT id, row_number() OVER (PARTITION BY site ORDER BY q DESC, id) AS n FROM p)
      SELECT id FROM r WHERE n > greatest(1, (SELECT floor(count(*) * 0.02 + 1e-9) FROM p))""",
    "p6_found": f"""
      WITH {_LINES},
      s AS (SELECT site, count(*) AS docs FROM l GROUP BY site),
      f AS (SELECT k.site, key FROM k JOIN s USING (site) WHERE key <> '' GROUP BY k.site, key, docs HAVING count(DISTINCT id) >= greatest(5, 0.2 * docs - 1e-9))
      SELECT id, CAST(line_no AS INTEGER) AS line_no FROM k SEMI JOIN f USING (site, key)""",
    "p4_found": f"""
      WITH h AS (SELECT query_id, id AS page_id, max(semantic_score) AS a, max(pagerank) AS b, max(CASE WHEN quality > 0 AND NOT isnan(quality) THEN quality END) AS c
                 FROM search_results JOIN {_LATEST} USING (url) GROUP BY 1, 2),
      n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1),
      r AS (SELECT h.query_id, page_id,
              CASE WHEN a IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY a DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, a) - 1) / 2.0) / n END AS x,
              CASE WHEN b IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, b) - 1) / 2.0) / n END AS y,
              CASE WHEN c IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY c DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, c) - 1) / 2.0) / n END AS z
            FROM h JOIN n USING (query_id)),
      w AS (SELECT query_id, page_id, (x + y + z) / 3 AS m, round(1.5 * x + y + z, 9) AS a, round(x + 1.5 * y + z, 9) AS b, round(x + y + 1.5 * z, 9) AS c FROM r),
      v AS (SELECT w.query_id, page_id, m,
              (rank() OVER (PARTITION BY w.query_id ORDER BY a) + (count(*) OVER (PARTITION BY w.query_id, a) - 1) / 2.0) / n AS x,
              (rank() OVER (PARTITION BY w.query_id ORDER BY b) + (count(*) OVER (PARTITION BY w.query_id, b) - 1) / 2.0) / n AS y,
              (rank() OVER (PARTITION BY w.query_id ORDER BY c) + (count(*) OVER (PARTITION BY w.query_id, c) - 1) / 2.0) / n AS z FROM w JOIN n USING (query_id)),
      o AS (SELECT query_id, page_id, m, list_sort([x, y, z]) AS s FROM v),
      f AS (SELECT query_id, page_id, m, least(1, 3 * least(1 - (1 - s[1]) ** 3, 3 * s[2] ** 2 - 2 * s[2] ** 3, s[3] ** 3)) AS rho FROM o)
      SELECT query_id, page_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rho, 12), round(m, 12), page_id) = 1""",
    "p4_ranking": f"""
      WITH h AS (SELECT query_id, id AS page_id, max(semantic_score) AS a, max(pagerank) AS b, max(CASE WHEN quality > 0 AND NOT isnan(quality) THEN quality END) AS c
                 FROM search_results JOIN {_LATEST} USING (url) GROUP BY 1, 2),
      n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1),
      r AS (SELECT h.query_id, page_id,
              CASE WHEN a IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY a DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, a) - 1) / 2.0) / n END AS x,
              CASE WHEN b IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, b) - 1) / 2.0) / n END AS y,
              CASE WHEN c IS NULL THEN 1 ELSE (rank() OVER (PARTITION BY h.query_id ORDER BY c DESC NULLS LAST) + (count(*) OVER (PARTITION BY h.query_id, c) - 1) / 2.0) / n END AS z
            FROM h JOIN n USING (query_id)),
      o AS (SELECT query_id, page_id, (x + y + z) / 3 AS m, list_sort([x, y, z]) AS s FROM r),
      f AS (SELECT query_id, page_id, m, least(1, 3 * least(1 - (1 - s[1]) ** 3, 3 * s[2] ** 2 - 2 * s[2] ** 3, s[3] ** 3)) AS rho FROM o)
      SELECT query_id, page_id, round(rho, 9) AS rho, round(m, 9) AS mean_rank FROM f""",
}
