"""The engine's queries over the standard tables, each with the same query as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield import rules
from grainfield.functions import licenses, markup, texts, urls, vectors
from grainfield.operators import graph, quality, tables
from grainfield.operators.ranking import latest_by
from grainfield.plans import search
from grainfield.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64

LATEST = "(SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC) = 1)"
CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"
REVIEWS = "(SELECT DISTINCT * FROM quality_reviews)"
USABLE = f"len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PART = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}


def sql_part(name: str, url: str = "url") -> str:
    return f"regexp_extract({url}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {PART[name]})"


HOST = f"regexp_extract({sql_part('authority')}, '^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1)"
DOMAIN = f"regexp_replace(lower({HOST}), '^www\\.', '')"
PAIRS = f"[p for p in string_split({sql_part('query')}, '&') if p <> '']"
KEPT = f"[p for p in {PAIRS} if NOT list_contains([{', '.join(repr(x) for x in rules.TRACKING_PARAMS)}], split_part(p, '=', 1))]"
CLEAN = f"CASE WHEN len({KEPT}) = len({PAIRS}) THEN {sql_part('query')} ELSE array_to_string(list_sort({KEPT}), '&') END"


def query(sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(load(spark, d, "pages"), "id", "crawled_at")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each; copied rows are equal."""
    return load(spark, d, "chunks").dropDuplicates(["id"])


def reviews_of(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "quality_reviews").distinct()


def query_vectors(chunks: DataFrame) -> DataFrame:
    """The embedding of every usable chunk whose id is divisible by 100, as the query of that id."""
    good = chunks.filter((F.col("id") % 100 == 0) & search.usable(F.col("embedding"), DIM) & (vectors.norm(F.col("embedding")) > 0))
    return good.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


_SCORED_ALL = f"""q AS (SELECT id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM {CHUNKS} WHERE id % 100 = 0 AND {USABLE} AND len([x for x in embedding if x <> 0]) > 0),
  s AS (SELECT query_id, page_id, id AS chunk_id, idx, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM {CHUNKS}, q WHERE {USABLE} AND len([x for x in embedding if x <> 0]) > 0),
  b AS (SELECT * FROM s WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY query_id, page_id ORDER BY sim DESC, idx, chunk_id) = 1)"""


@query(f"WITH {_SCORED_ALL} SELECT query_id, page_id, chunk_id, round(sim, 6) AS similarity FROM b")
def search_best_chunk_all(spark: SparkSession, d: str) -> DataFrame:
    """The best chunk of every page for each of the query vectors."""
    chunks = chunks_of(spark, d)
    return search.best_chunks(chunks, query_vectors(chunks), DIM).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SCORED_ALL} SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, page_id) AS INTEGER) AS place FROM b QUALIFY place <= 100")
def search_pool_all(spark: SparkSession, d: str) -> DataFrame:
    """The hundred pages of each query vector from which twenty results are chosen."""
    chunks = chunks_of(spark, d)
    return search.pool(search.best_chunks(chunks, query_vectors(chunks), DIM, search.POOL * 20), 20).select("query_id", "page_id", "place")


@query()
def search_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Twenty diverse results of each of the query vectors with all that is shown of them; tested against a plain greedy choice."""
    chunks = chunks_of(spark, d)
    found = search.search(chunks, pages_of(spark, d), query_vectors(chunks), DIM, 20)
    return found.withColumns({"similarity": F.round("similarity", 6), "final_score": F.round("final_score", 6)})


@query(f"""WITH n AS (SELECT count(*) AS n FROM {LATEST})
  SELECT DISTINCT query_id, id AS page_id, round(semantic_score * (1 + ln(1 + pagerank * n)) * (CASE WHEN quality > 0 AND NOT isnan(quality) THEN quality ELSE 1 END) * (CASE WHEN p.compilable THEN 2 ELSE 1 END), 6) AS final_score
  FROM (SELECT query_id, url, semantic_score FROM search_results) s JOIN {LATEST} p USING (url), n WHERE semantic_score > 0""")
def search_final_score(spark: SparkSession, d: str) -> DataFrame:
    """Similarity weighted by authority, quality and compilability for all results given."""
    pages = pages_of(spark, d).select("url", F.col("id").alias("page_id"), "pagerank", F.when(~F.isnan("quality"), F.col("quality")).alias("quality"), "compilable")
    n = pages.agg(F.count("*").cast("double").alias("n"))
    hits = load(spark, d, "search_results").select("query_id", "url", "semantic_score").filter("semantic_score > 0").join(pages, "url").crossJoin(F.broadcast(n))
    score = vectors.final_score(F.col("semantic_score"), F.col("pagerank"), F.col("n"), F.col("quality"), F.col("compilable"))
    return hits.select("query_id", "page_id", F.round(score, 6).alias("final_score")).distinct()


@query("SELECT DISTINCT query_id, url FROM search_results QUALIFY semantic_score >= 0.75 * max(semantic_score) OVER (PARTITION BY query_id)")
def search_relative_cut(spark: SparkSession, d: str) -> DataFrame:
    """Results within a quarter of their query's best score; the best comes from an aggregate, so a hot query is no problem."""
    hits = load(spark, d, "search_results").select("query_id", "url", "semantic_score")
    top = hits.groupBy(F.col("query_id").alias("_q")).agg(F.max("semantic_score").alias("_top"))
    return hits.join(top, F.col("query_id") == F.col("_q")).filter(F.col("semantic_score") >= 0.75 * F.col("_top")).select("query_id", "url").distinct()


@query(f"""WITH e AS (SELECT page_id, id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM {CHUNKS} WHERE len(embedding) = {DIM}),
  m AS (SELECT page_id, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM e GROUP BY page_id, i),
  l AS (SELECT page_id, sqrt(sum(x * x)) AS l FROM m GROUP BY page_id)
  SELECT page_id, max(n) AS n, round(max(CASE WHEN i = 1 THEN x / l END), 6) AS first, round(max(CASE WHEN i = {DIM} THEN x / l END), 6) AS last FROM m JOIN l USING (page_id) WHERE l > 0 AND NOT isnan(l) GROUP BY page_id""")
def page_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mean vector of each page: first and last number."""
    c = vectors.centroids(chunks_of(spark, d), "page_id", "embedding", DIM).filter((vectors.norm(F.col("centroid")) > 0) & ~F.isnan(F.col("centroid")[0]))
    return c.select("page_id", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[DIM - 1], 6).alias("last"))


@query(f"SELECT id, CAST(len(embedding) AS INTEGER) AS dim, round(sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])), 4) AS length FROM {CHUNKS} WHERE {USABLE.replace(f'len(embedding) = {DIM}', 'len(embedding) > 0')}")
def chunk_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of every vector of finite numbers."""
    good = chunks_of(spark, d).filter(vectors.present(F.col("embedding")) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return good.select("id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


_EDGES = f"""v AS (SELECT DISTINCT id FROM {LATEST}), e AS (SELECT DISTINCT from_page_id AS src, to_page_id AS dst FROM links WHERE from_page_id IN (SELECT id FROM v) AND to_page_id IN (SELECT id FROM v)),
  o AS (SELECT src, count(*) AS out_degree FROM e GROUP BY src)"""


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT count(*) AS n FROM v), r AS (
    SELECT id, 1.0::DOUBLE / n AS rank, 0 AS i FROM v, n
    UNION ALL
    (WITH c AS (SELECT * FROM r WHERE i < 50), lost AS (SELECT coalesce(sum(rank), 0) AS lost FROM c LEFT JOIN o ON id = src WHERE src IS NULL),
      got AS (SELECT dst, sum(rank / out_degree) AS got FROM c JOIN o ON id = src JOIN e USING (src) GROUP BY dst)
     SELECT c.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n), i + 1 FROM c LEFT JOIN got ON c.id = dst, lost, n))
  SELECT id, round(rank, 9) AS rank FROM r WHERE i = 50""")
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    """Fifty steps over the pages and their links."""
    return graph.page_rank(load(spark, d, "pages").select("id"), load(spark, d, "links")).select("id", F.round("rank", 9).alias("rank"))


@query(f"WITH {_EDGES} SELECT src, out_degree FROM o")
def out_degree(spark: SparkSession, d: str) -> DataFrame:
    """Links out of each page to other known pages."""
    return graph.out_degrees(graph.valid_edges(load(spark, d, "pages").select("id").distinct(), load(spark, d, "links")))


@query(f"WITH {_EDGES} SELECT count(*) AS n_dangling FROM v WHERE id NOT IN (SELECT src FROM o)")
def dangling_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many pages have no link to a known page."""
    ids = load(spark, d, "pages").select("id").distinct()
    return ids.join(graph.valid_edges(ids, load(spark, d, "links")), F.col("id") == F.col("src"), "left_anti").agg(F.count("*").alias("n_dangling"))


@query("SELECT DISTINCT s.query_id AS from_page_id, id AS to_page_id FROM search_results s JOIN (SELECT DISTINCT id, url FROM pages) USING (url)")
def links_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Addresses found, turned into edges to known pages."""
    found = load(spark, d, "search_results").select(F.col("query_id").alias("page_id"), F.col("url").alias("href"), F.col("title").alias("anchor"))
    return graph.links_to_pages(found, load(spark, d, "pages").select("id", "url").distinct()).select("from_page_id", "to_page_id")


_PARAS = f"""l AS (SELECT id, string_split(coalesce(text_content, ''), chr(10)) AS t FROM {LATEST}), u AS (SELECT id, unnest([{TRIM.format("x")} for x in t]) AS p FROM l), k AS (SELECT * FROM u WHERE strlen(p) > 20)"""


@query(f"WITH {_PARAS} SELECT id, count(*) AS n, sum(strlen(p))::BIGINT AS bytes FROM k GROUP BY id")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each page: how many, how long."""
    p = pages_of(spark, d).select("id", F.explode(texts.paragraphs(F.col("text_content"))).alias("p"))
    return p.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("p").cast("long")).alias("bytes"))


@query(f"WITH {_PARAS} SELECT md5(p) AS text_hash, min(id) AS first_page, count(*) AS n FROM k GROUP BY p")
def paragraph_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of the corpus once, with the first page it stands on; hashes are shuffled, not texts."""
    p = pages_of(spark, d).select("id", F.explode(texts.paragraphs(F.col("text_content"))).alias("p"))
    return p.select(F.md5("p").alias("text_hash"), "id").groupBy("text_hash").agg(F.min("id").alias("first_page"), F.count("*").alias("n"))


@query(r"SELECT doc_id, md5(array_to_string([w for w in regexp_split_to_array(coalesce(text, ''), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') if w <> ''][1:500], ' ')) AS head FROM documents")
def first_500_words_all(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the first 500 words of every document; also tested against plain Python."""
    return load(spark, d, "documents").select("doc_id", F.md5(texts.first_words(F.col("text"))).alias("head"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 200 THEN left(text, list_max([i for i in range(50, 201) if strlen(left(text, i)) <= 200])) || '...' ELSE text END AS snippet FROM documents")
def snippets_all(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of each document, null for null texts; also tested against plain Python."""
    return load(spark, d, "documents").select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN t LIKE '%gnu affero general public license%' THEN 'AGPL-3.0'
    WHEN t LIKE '%gnu general public license%' THEN CASE WHEN t LIKE '%version 3%' THEN 'GPL-3.0' ELSE '' END
    WHEN t LIKE '%gnu lesser general public license%' THEN CASE WHEN t LIKE '%version 3%' THEN 'LGPL-3.0' ELSE '' END
    WHEN t LIKE '%mozilla public license%' THEN 'MPL-2.0' WHEN t LIKE '%creative commons%' AND t LIKE '%sharealike%' THEN 'CC-BY-SA-4.0' WHEN t LIKE '%creative commons%' AND t LIKE '%cc0%' THEN 'CC0-1.0'
    WHEN t LIKE '%unlicense%' OR (t LIKE '%public domain%' AND t NOT LIKE '%not public domain%') THEN 'Unlicense' ELSE '' END AS spdx FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def license_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Licence of each document by its words."""
    return load(spark, d, "documents").select("doc_id", licenses.license_of_text(F.col("text")).alias("spdx"))


def _cases(column: str, pairs, fn: str = "lower") -> str:
    return "CASE " + " ".join(f"WHEN contains({fn}({column}), '{a}') THEN '{b}'" for a, b in pairs) + " END"


@query(f"SELECT id, {_cases('license_url', rules.LICENSE_URLS + rules.PUBLIC_DOMAIN_URLS)} AS by_url, {_cases('trim(license_type)', [(n, k) for n, _, k in rules.FOOTER_NAMES], 'upper')} AS by_name FROM {LATEST}")
def license_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Licence of each page by its licence URL and by its name."""
    return pages_of(spark, d).select("id", licenses.license_of_url(F.col("license_url")).alias("by_url"), licenses.license_of_footer(F.col("license_type")).alias("by_name"))


@query(f"SELECT DISTINCT url, {DOMAIN} AS domain, CASE WHEN {HOST} LIKE 'www.%' AND length({HOST}) > 4 THEN {HOST}[5:] ELSE {HOST} END AS shown FROM pages")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    """Domain of each page address, folded and as shown."""
    return load(spark, d, "pages").select("url", urls.domain(F.col("url")).alias("domain"), urls.display_domain(F.col("url")).alias("shown")).distinct()


@query(f"SELECT DISTINCT url, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN {CLEAN} <> '' THEN '?' || {CLEAN} ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS clean FROM pages")
def url_strip_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses without tracking parameters."""
    return load(spark, d, "pages").select("url", urls.strip_tracking(F.col("url")).alias("clean")).distinct()


@query(f"""SELECT DISTINCT url, CASE WHEN lower({sql_part("scheme")}) = 'http' THEN 'https' ELSE lower({sql_part("scheme")}) END || '://' || {sql_part("authority")} || regexp_replace({sql_part("path")}, '/+$', '')
  || CASE WHEN {CLEAN} <> '' THEN '?' || {CLEAN} ELSE '' END AS normal FROM pages""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    """One spelling for each page address."""
    return load(spark, d, "pages").select("url", urls.normalise(F.col("url")).alias("normal")).distinct()


_STRIPPED = f"(SELECT DISTINCT url AS given, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN {CLEAN} <> '' THEN '?' || {CLEAN} ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS url FROM pages)"
_CANON = f"""CASE WHEN lower({HOST}) LIKE 'www.%' THEN lower({sql_part("scheme")}) || '://' || regexp_replace(lower({sql_part("authority")}), '^((?:.*@)?)www\\.', '\\1') || {sql_part("path")}
  || CASE WHEN {sql_part("query")} <> '' THEN '?' || {sql_part("query")} ELSE '' END || CASE WHEN {sql_part("fragment")} <> '' THEN '#' || {sql_part("fragment")} ELSE '' END ELSE url END"""


@query(f"SELECT given AS url, {_CANON} AS canonical FROM {_STRIPPED}")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The address under which each page is kept."""
    return load(spark, d, "pages").select("url", urls.canonical(F.col("url")).alias("canonical")).distinct()


@query(f"""SELECT DISTINCT url, regexp_matches(lower({sql_part("path")}), '\\.({"|".join(x[1:] for x in rules.BINARY_SUFFIXES)})$') AS is_binary, regexp_matches({sql_part("query")}, '(^|&)action=({"|".join(rules.WIKI_ACTIONS)})(&|$)') AS is_action,
  list_contains([{", ".join(repr(x) for x in rules.WIKI_META_PREFIXES)}], regexp_extract({sql_part("path")}, '^(/wiki/[A-Za-z_]+:)', 1)) AS is_meta, {" OR ".join(f"({DOMAIN} LIKE '%{p}' AND {DOMAIN} <> 'en{p}')" for p in rules.WIKI_PROJECTS)} AS is_foreign FROM pages""")
def url_flags(spark: SparkSession, d: str) -> DataFrame:
    """What kind of address each is: a file, a wiki's form, a page about the wiki, a wiki of another language."""
    u = F.col("url")
    return load(spark, d, "pages").select("url", urls.is_binary(u).alias("is_binary"), urls.is_wiki_action(u).alias("is_action"), urls.is_wiki_meta(u).alias("is_meta"), urls.is_foreign_wiki(urls.domain(u)).alias("is_foreign")).distinct()


@query(f"""SELECT url AS given, CASE WHEN lower({sql_part("scheme")}) = 'http' THEN 'https' ELSE lower({sql_part("scheme")}) END || '://' || {sql_part("authority")} || regexp_replace({sql_part("path")}, '/+$', '')
  || CASE WHEN {CLEAN} <> '' THEN '?' || {CLEAN} ELSE '' END AS url FROM search_results""".join(["SELECT url, count(*) AS inbound FROM (", ") WHERE url <> '' GROUP BY url"]))
def url_sightings(spark: SparkSession, d: str) -> DataFrame:
    """How often each normalised address was found."""
    return tables.sightings(load(spark, d, "search_results"), urls.normalise(F.col("url")))


@query("SELECT url, round(ln(1 + inbound), 6) AS priority FROM (SELECT url, count(*) AS inbound FROM search_results GROUP BY url ORDER BY inbound DESC, url LIMIT 150) ORDER BY inbound DESC, url LIMIT 50")
def frontier_top(spark: SparkSession, d: str) -> DataFrame:
    """The fifty addresses found most often, by priority."""
    seen = tables.sightings(load(spark, d, "search_results"), F.col("url"))
    return tables.top_of_frontier(seen, 50).select("url", F.round("priority", 6).alias("priority"))


@query(f"SELECT url, CASE WHEN url IN (SELECT url FROM pages WHERE quality > 0.5) THEN 'indexed' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'not http' ELSE 'unwanted' END AS reason FROM (SELECT DISTINCT url FROM search_results) WHERE url IN (SELECT url FROM pages WHERE quality > 0.5) OR NOT regexp_matches(lower(url), '^https?://') OR contains(url, 'utm_source')")
def frontier_prune(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that need no fetching, with the reason."""
    found = load(spark, d, "search_results").select("url").distinct()
    return tables.prune_frontier(found, load(spark, d, "pages").filter("quality > 0.5"), F.col("url").contains("utm_source"))


@query(f"SELECT id, page_id, idx FROM {CHUNKS} QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id, idx, id) = 1")
def chunk_first_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose text comes first in the corpus."""
    return tables.first_texts(chunks_of(spark, d)).select("id", "page_id", "idx")


@query(f"""WITH d AS (SELECT id, {DOMAIN} AS domain FROM {LATEST}), x AS (SELECT id, unnest([array_to_string(string_split(domain, '.')[i:], '.') for i in range(1, len(string_split(domain, '.')) + 1)]) AS above FROM d),
  l AS (SELECT DISTINCT array_to_string(string_split({DOMAIN}, '.')[-2:], '.') AS above FROM search_results) SELECT above AS listed, count(*) AS n FROM x JOIN l USING (above) GROUP BY above""")
def domain_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Pages at or below each listed domain, by an equi-join on all domains above a page's."""
    listed = load(spark, d, "search_results").select(F.substring_index(urls.domain(F.col("url")), ".", -2).alias("listed")).distinct()
    above = pages_of(spark, d).select(F.explode(urls.suffixes_of(urls.domain(F.col("url")))).alias("listed"))
    return above.join(listed, "listed").groupBy("listed").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT page_id, count(*) AS n FROM {CHUNKS} GROUP BY page_id), m AS (SELECT id, regexp_replace(lower(url), '^(https?://(?:[^/?#@]*@)?)www\\.', '\\1') AS canonical, CASE WHEN lower({HOST}) LIKE 'www.%' THEN 1 ELSE 0 END AS www, coalesce(n, 0) AS n FROM {LATEST} LEFT JOIN c ON id = page_id)
  SELECT id, canonical, count(*) OVER (PARTITION BY canonical) AS n_merged, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, www, id) = 1 AS is_winner FROM m""")
def www_winners(spark: SparkSession, d: str) -> DataFrame:
    """Of pages that differ by www. only, the one that is kept."""
    sizes = chunks_of(spark, d).groupBy("page_id").agg(F.count("*").alias("n"))
    pages = pages_of(spark, d).join(sizes, F.col("id") == F.col("page_id"), "left").select("id", "url", F.coalesce("n", F.lit(0)).alias("n"))
    canon = F.regexp_replace(F.lower("url"), r"^(https?://(?:[^/?#@]*@)?)www\.", "$1")
    return tables.canonical_winners(pages, canon, F.lower(urls.host(F.col("url"))).startswith("www."), "n")


@query(f"SELECT id FROM {LATEST} ANTI JOIN (SELECT page_id AS id FROM chunks) USING (id)")
def pages_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages not cut into chunks yet."""
    return pages_of(spark, d).select("id").join(load(spark, d, "chunks").select(F.col("page_id").alias("id")), "id", "left_anti")


@query(f"SELECT id FROM {LATEST} ANTI JOIN (SELECT page_id AS id FROM quality_reviews) USING (id)")
def pages_without_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Pages nobody reviewed."""
    return pages_of(spark, d).select("id").join(load(spark, d, "quality_reviews").select(F.col("page_id").alias("id")), "id", "left_anti")


@query(f"SELECT c.id, c.page_id, url FROM {CHUNKS} c JOIN {LATEST} p ON c.page_id = p.id WHERE embedding IS NULL OR len(embedding) = 0")
def chunks_to_embed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector, with their page's address."""
    missing = chunks_of(spark, d).filter(~vectors.present(F.col("embedding"))).select("id", "page_id")
    return missing.join(pages_of(spark, d).select(F.col("id").alias("page_id"), "url"), "page_id").select("id", "page_id", "url")


@query(f"SELECT page_id, count(*) AS n, bool_and(coalesce(len(embedding), 0) > 0) AS complete FROM {CHUNKS} GROUP BY page_id")
def embedding_progress(spark: SparkSession, d: str) -> DataFrame:
    """Whether all chunks of a page have a vector."""
    return chunks_of(spark, d).groupBy("page_id").agg(F.count("*").alias("n"), F.bool_and(vectors.present(F.col("embedding"))).alias("complete"))


@query(f"SELECT id FROM {LATEST} WHERE text_content = '' OR text_content IS NULL")
def hollow_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without text."""
    return pages_of(spark, d).filter(F.coalesce("text_content", F.lit("")) == "").select("id")


@query("SELECT row_number() OVER (ORDER BY n DESC, contributor) AS place, contributor, n FROM (SELECT contributor, count(*) AS n FROM (SELECT DISTINCT * FROM contributions) WHERE contributor <> '' GROUP BY 1) ORDER BY n DESC, contributor LIMIT 10")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The ten contributors with most contributions."""
    return quality.leaderboard(load(spark, d, "contributions").distinct())


@query("SELECT lower(trim(type)) AS type, contributor, count(*) AS n FROM (SELECT DISTINCT * FROM contributions) WHERE contributor <> '' GROUP BY 1, 2")
def contributions_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Contributions by kind and contributor."""
    rows = load(spark, d, "contributions").distinct().filter(F.col("contributor") != "")
    return rows.groupBy(F.lower(F.trim("type")).alias("type"), "contributor").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT contributor, left(sha256(contributor), 16) AS fingerprint FROM contributions WHERE contributor <> ''")
def contributor_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Short hash of each contributor."""
    return load(spark, d, "contributions").filter(F.col("contributor") != "").select("contributor").distinct().withColumn("fingerprint", texts.fingerprint(F.col("contributor")))


_FIRST = f"(SELECT * FROM {REVIEWS} WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY page_id, contributor ORDER BY reviewed_at, id) = 1)"


@query(f"SELECT page_id, contributor, id FROM {_FIRST}")
def review_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first valid review of each contributor on each page."""
    return quality.first_reviews(reviews_of(spark, d).filter(~F.isnan("score"))).select("page_id", "contributor", "id")


@query(f"SELECT page_id, count(*) AS n_reviews, round(exp(avg(ln(greatest(score, 0.01)))), 6) AS quality FROM {_FIRST} GROUP BY page_id")
def quality_geomean(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each reviewed page."""
    return quality.geometric_quality(quality.first_reviews(reviews_of(spark, d).filter(~F.isnan("score")))).select("page_id", "n_reviews", F.round("quality", 6).alias("quality"))


@query(f"SELECT (SELECT count(*) FROM {LATEST}) AS n_pages, count(*) AS n_covered, round(count(*) / (SELECT count(*) FROM {LATEST}), 6) AS coverage FROM (SELECT page_id FROM {REVIEWS} WHERE page_id IN (SELECT id FROM pages) GROUP BY 1 HAVING count(*) >= 2)")
def quality_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The part of the pages with at least two reviews."""
    return quality.coverage(load(spark, d, "pages").select("id").distinct(), reviews_of(spark, d), 2).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT {DOMAIN} AS domain, count(*) AS n_failures FROM {LATEST} WHERE consecutive_failures > 0 AND {DOMAIN} <> '' GROUP BY 1 HAVING count(*) >= 2")
def failing_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains with at least two pages that failed."""
    rows = pages_of(spark, d).filter("consecutive_failures > 0").select(urls.domain(F.col("url")).alias("domain"), F.lit("status 404").alias("reason"))
    return quality.failing_domains(rows, "domain", "reason", 2)


@query(f"SELECT id, coalesce(epoch_us(last_validated), -1) AS validated_us FROM {LATEST} ORDER BY last_validated ASC NULLS FIRST, id LIMIT 100")
def validation_queue(spark: SparkSession, d: str) -> DataFrame:
    """The hundred pages validated longest ago, those never validated first."""
    return pages_of(spark, d).select("id", "last_validated").orderBy(F.col("last_validated").asc_nulls_first(), "id").limit(100).select("id", F.coalesce(F.unix_micros("last_validated"), F.lit(-1).cast("long")).alias("validated_us"))


@query("SELECT max_by(url, crawled_at) AS url, id, epoch_us(max(crawled_at)) AS crawled_us, min_by(pagerank, crawled_at) AS pagerank, max_by(md5(coalesce(text_content, '')), crawled_at) AS text_hash FROM pages GROUP BY id")
def page_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest fetch of each page written over the oldest, which keeps its rank."""
    cols = ["id", "url", "crawled_at", "pagerank", "text_hash"]
    rows = load(spark, d, "pages").withColumn("text_hash", F.md5(F.coalesce("text_content", F.lit("")))).select(*cols)
    old = rows.groupBy("id").agg(F.min(F.struct("crawled_at", "url", "pagerank", "text_hash")).alias("r")).select("id", "r.url", "r.crawled_at", "r.pagerank", "r.text_hash")
    new = rows.groupBy("id").agg(F.max(F.struct("crawled_at", "url", "pagerank", "text_hash")).alias("r")).select("id", "r.url", "r.crawled_at", "r.pagerank", "r.text_hash")
    return tables.upsert(old, new, "id", keep=["pagerank"]).select("id", "url", F.unix_micros("crawled_at").alias("crawled_us"), "pagerank", "text_hash")


_GONE = "SELECT id FROM pages WHERE consecutive_failures >= 3"


@query(f"""SELECT 'pages' AS t, count(*) AS n FROM pages WHERE id NOT IN ({_GONE}) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE page_id NOT IN ({_GONE})
  UNION ALL SELECT 'links', count(*) FROM links WHERE from_page_id NOT IN ({_GONE}) AND to_page_id NOT IN ({_GONE}) UNION ALL SELECT 'quality_reviews', count(*) FROM quality_reviews WHERE page_id NOT IN ({_GONE})""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of each table when pages that failed three times go."""
    t = {n: load(spark, d, n) for n in ("pages", "chunks", "links", "quality_reviews")}
    left = tables.delete_cascade(t["pages"].filter("consecutive_failures >= 3").select("id"), *t.values())
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT id, idx FROM chunks WHERE page_id NOT IN (SELECT id FROM pages WHERE consecutive_failures > 0) UNION ALL SELECT id, idx + 1000 FROM chunks WHERE page_id IN (SELECT id FROM pages WHERE consecutive_failures > 0)")
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of some pages replaced by new ones."""
    chunks = load(spark, d, "chunks").select("id", "page_id", "idx")
    again = load(spark, d, "pages").filter("consecutive_failures > 0").select(F.col("id").alias("page_id")).distinct()
    fresh = chunks.join(again, "page_id", "left_semi").select("id", "page_id", (F.col("idx") + 1000).alias("idx"))
    return tables.replace_children(chunks, fresh, "page_id").select("id", "idx")


@query(f"SELECT id, sha256(coalesce(text_content, '')) AS hash FROM {LATEST}")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each page's text."""
    return pages_of(spark, d).select("id", texts.content_hash(F.coalesce("text_content", F.lit(""))).alias("hash"))


@query(f"SELECT (SELECT count(*) FROM {LATEST}) AS pages, (SELECT count(*) FROM {CHUNKS}) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT from_page_id, to_page_id FROM links)) AS links, (SELECT count(DISTINCT page_id) FROM quality_reviews) AS reviewed")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    p, c = one(load(spark, d, "pages").select("id").distinct(), "pages"), one(load(spark, d, "chunks").select("id").distinct(), "chunks")
    e, r = one(load(spark, d, "links").select("from_page_id", "to_page_id").distinct(), "links"), one(load(spark, d, "quality_reviews").select("page_id").distinct(), "reviewed")
    return p.crossJoin(c).crossJoin(e).crossJoin(r)


_RANKED = f"SELECT id, ((rank() OVER (ORDER BY pagerank DESC NULLS LAST) + (count(*) OVER (PARTITION BY pagerank) - 1) / 2.0) + (rank() OVER (ORDER BY failures DESC) + (count(*) OVER (PARTITION BY failures) - 1) / 2.0)) AS s FROM (SELECT id, pagerank, consecutive_failures AS failures FROM {LATEST})"


@query(f"SELECT id, s AS rank_sum, round(1 - (s - (SELECT min(s) FROM ({_RANKED}))) / ((SELECT max(s) FROM ({_RANKED})) - (SELECT min(s) FROM ({_RANKED}))), 6) AS quality FROM ({_RANKED})")
def rank_sum_quality(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by two scores added and scaled to 0..1."""
    pages = pages_of(spark, d).select("id", "pagerank", F.col("consecutive_failures").alias("failures"))
    return quality.rank_sum_quality(pages, ["pagerank", "failures"]).select("id", F.col("rank_sum").cast("double").alias("rank_sum"), F.round("quality", 6).alias("quality"))


@query(f"""SELECT id, CAST(len(regexp_extract_all(t, '(?m)^```|^    \\S')) + len(regexp_extract_all(t, '\\$[^$\\n]+\\$|=')) + len(regexp_extract_all(t, '\\[\\d+\\]|\\((?:19|20)\\d\\d\\)')) + len(regexp_extract_all(t, '(?i)\\b(?:example|exercise)\\b'))
  + len(regexp_extract_all(t, '(?m)^#{{1,6}} ')) + len(regexp_extract_all(t, '(?m)^[ \\t\\r\\f\\v\\n]*(?:[-*•]|\\d+\\.) ')) AS INTEGER) AS score FROM (SELECT id, coalesce(text_content, '') AS t FROM {LATEST})""")
def structural_score(spark: SparkSession, d: str) -> DataFrame:
    """Signs of worked material on each page."""
    return pages_of(spark, d).select("id", texts.structural_score(F.col("text_content")).cast("int").alias("score"))


@query(f"SELECT id, round(pow(0.5, date_diff('day', CAST(crawled_at AS DATE), DATE '2026-01-01') / 90.0), 6) AS freshness FROM {LATEST}")
def page_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Freshness of each page on a fixed day."""
    days = F.datediff(F.lit("2026-01-01").cast("date"), F.col("crawled_at").cast("date"))
    return pages_of(spark, d).select("id", F.round(texts.freshness(days), 6).alias("freshness"))


@query(f"""WITH l AS (SELECT id, title, [{TRIM.format("x")} for x in string_split(coalesce(text_content, ''), chr(10))] AS t FROM {LATEST})
  SELECT id, {TRIM.format("coalesce(title, '')")} AS title, CAST(least(30, len([x for x in t if strlen(x) >= 50])) AS INTEGER) AS n_paragraphs, md5({TRIM.format("regexp_replace(array_to_string([x for x in t if x <> ''], ' '), '[ \\t\\r\\n\\f\\v\\x{A0}]+', ' ', 'g')")}) AS text_hash FROM l""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages set as HTML and read again: title, paragraphs, text."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")
    body = F.array_join(F.transform(F.split(F.coalesce("text_content", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><script>var a = '<p>no</p>';</script></head><body><nav><a href='/'>Home</a></nav><article>"), body, F.lit("<aside><p>an aside of more than fifty bytes, which is no part of the text</p></aside></article><footer>x</footer></body></html>"))
    read = pages_of(spark, d).select("id", markup.html_page(html, F.col("url")).alias("p"))
    return read.select("id", "p.title", F.size("p.paragraphs").alias("n_paragraphs"), F.md5("p.text").alias("text_hash"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN json_valid(props) THEN 1 ELSE 0 END)::BIGINT AS n_json FROM events GROUP BY 1")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and how many carry valid JSON."""
    ok = F.try_parse_json("props").isNotNull()
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_json"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Diverse search results of each query vector."""
    return search_diverse(spark, d)

