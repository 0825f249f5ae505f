"""More queries of the engine: store jobs over the standard tables, and page, link and record functions over small cases written out here with their results."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield import rules, sources
from grainfield.functions import licenses, markup, texts, urls, vectors
from grainfield.operators import graph, quality, store, tables
from grainfield.plans import search
from grainfield.plans.catalog import CHUNKS, DIM, DOMAIN, HOST, LATEST, ORACLES, QUERIES, TRIM, USABLE, chunks_of, pages_of, query, query_vectors
from grainfield.session import load, shared_path, stored

__all__ = ["ORACLES", "QUERIES"]
FAR = "TIMESTAMP '2026-01-01 00:00:00'"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(literal(y) for y in x) + "]"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of results."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(literal(x) for x in r) + ')' for r in rows)}) AS t({columns})"


# --- store jobs


@query("SELECT coalesce(license_type, '') AS license_type, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1")
def raw_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL over the tables as views."""
    sources.register_tables(spark, d, ("pages",))
    return spark.sql("SELECT coalesce(license_type, '') AS license_type, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1")


@query("SELECT s.url, min(p.id) AS id FROM (SELECT DISTINCT url FROM search_results WHERE url IS NOT NULL) s LEFT JOIN pages p USING (url) GROUP BY s.url")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their exact URL."""
    return store.lookup(load(spark, d, "pages"), load(spark, d, "search_results"))


@query("SELECT url, url IN (SELECT url FROM pages WHERE crawled_at >= TIMESTAMP '2024-01-01') OR url IN (SELECT url FROM search_results WHERE semantic_score > 0.9) AS known FROM (SELECT DISTINCT url FROM search_results)")
def url_known(spark: SparkSession, d: str) -> DataFrame:
    """Whether a URL found is a page or waits already."""
    found = load(spark, d, "search_results")
    recent = load(spark, d, "pages").filter(F.col("crawled_at") >= F.lit("2024-01-01").cast("timestamp"))
    return store.url_known(found, recent, found.filter("semantic_score > 0.9"))


_RETOLD = f"(SELECT id, CASE WHEN license_type IS NULL OR license_type = '' THEN coalesce(title, '') || ' ' || coalesce(title, '') ELSE text_content END AS t, license_type IS NULL OR license_type = '' AS changed, consecutive_failures FROM {LATEST})"


@query(f"""SELECT r.id, CASE WHEN changed THEN sha256(t) ELSE 'as before' END AS hash, CAST(CASE WHEN changed THEN 0 ELSE consecutive_failures END AS INTEGER) AS failures,
    CASE WHEN changed THEN CAST(strlen({TRIM.format('t')}) > 20 AS INTEGER) ELSE coalesce(n, 0) END AS n_chunks FROM {_RETOLD} r LEFT JOIN (SELECT page_id, count(*) AS n FROM {CHUNKS} GROUP BY 1) c ON r.id = c.page_id""")
def content_update(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a licence told anew: text, hash, failures and chunks."""
    pages = pages_of(spark, d)
    title = F.coalesce("title", F.lit(""))
    bare = F.coalesce("license_type", F.lit("")) == ""
    new = pages.filter(bare).select("id", F.concat_ws(" ", title, title).alias("text_content"))
    after, chunks = store.update_content(pages, chunks_of(spark, d), new, 1 << 53)
    sizes = chunks.groupBy(F.col("page_id").alias("_p")).agg(F.count("*").alias("n"))
    return after.join(sizes, F.col("id") == F.col("_p"), "left").select("id", F.when(bare, F.col("content_hash")).otherwise("as before").alias("hash"), F.col("consecutive_failures").cast("int").alias("failures"), F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


@query(f"SELECT id, coalesce(consecutive_failures, 0) + CAST(consecutive_failures > 0 AS INTEGER) AS failures, epoch_us(CASE WHEN consecutive_failures > 0 THEN {FAR} ELSE last_validated END) AS validated_us, consecutive_failures >= 2 AS gone FROM {LATEST}")
def failure_count(spark: SparkSession, d: str) -> DataFrame:
    """Pages that failed before fail once more."""
    pages = pages_of(spark, d)
    after = store.count_failures(pages, pages.filter("consecutive_failures > 0").select("id"), F.lit("2026-01-01").cast("timestamp"))
    return after.select("id", F.col("consecutive_failures").cast("int").alias("failures"), F.unix_micros("last_validated").alias("validated_us"), "gone")


@query(f"SELECT id, CASE WHEN consecutive_failures > 0 THEN NULL ELSE etag END AS etag, CASE WHEN consecutive_failures > 0 THEN 'never' ELSE last_modified END AS last_modified FROM {LATEST}")
def validators_update(spark: SparkSession, d: str) -> DataFrame:
    """Validators of failed pages set, one of them to null."""
    pages = pages_of(spark, d).select("id", "etag", "last_modified", "consecutive_failures")
    new = pages.filter("consecutive_failures > 0").select("id", F.lit(None).cast("string").alias("etag"), F.lit("never").alias("last_modified"))
    return tables.set_columns(pages, new, "id", nulls=True).select("id", "etag", "last_modified")


_WWW = f"""c AS (SELECT page_id, count(*) AS n FROM {CHUNKS} GROUP BY page_id), m AS (SELECT id, url, regexp_replace(lower(url), '^(https?://(?:[^/?#@]*@)?)www\\.', '\\1') AS canonical, lower({HOST}) LIKE 'www.%' AS www, coalesce(n, 0) AS n FROM {LATEST} LEFT JOIN c ON id = page_id),
  w AS (SELECT *, count(*) OVER (PARTITION BY canonical) AS k, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, www, id) AS place FROM m)"""


def _merged(spark: SparkSession, d: str):
    canon = F.regexp_replace(F.lower("url"), r"^(https?://(?:[^/?#@]*@)?)www\.", "$1")
    pages = stored(pages_of(spark, d).select("id", "url"), "pages")
    return store.merge_www(pages, chunks_of(spark, d), load(spark, d, "links"), load(spark, d, "quality_reviews"), canon, store.is_www_url(F.col("url")))


@query(f"WITH {_WWW} SELECT id, CASE WHEN k > 1 OR www THEN canonical ELSE url END AS url FROM w WHERE place = 1")
def www_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pages after those that differ by www. were made one."""
    return _merged(spark, d)[0]["pages"]


@query(f"""WITH {_WWW}, g AS (SELECT id FROM w WHERE place > 1) SELECT (SELECT count(*) FROM g) AS merged, (SELECT count(*) FROM w WHERE k = 1 AND www) AS renamed, (SELECT count(*) FROM {CHUNKS} WHERE page_id NOT IN (SELECT id FROM g)) AS chunks,
  (SELECT count(*) FROM links WHERE from_page_id NOT IN (SELECT id FROM g) AND to_page_id NOT IN (SELECT id FROM g)) AS links""")
def www_merge_report(spark: SparkSession, d: str) -> DataFrame:
    """How many pages were merged and renamed, and what is left beside them."""
    left, report = _merged(spark, d)
    one = lambda n: left[n].agg(F.count("*").alias(n))
    return report.crossJoin(one("chunks")).crossJoin(one("links"))


@query("SELECT id FROM contributions GROUP BY id ORDER BY md5(CAST(id AS VARCHAR) || ':1'), id LIMIT 100")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred contributions at random."""
    return store.sample_n(load(spark, d, "contributions").select("id").distinct(), "id", 100)


@query(f"SELECT id, url FROM {LATEST} WHERE id NOT IN (SELECT page_id FROM quality_reviews WHERE page_id IS NOT NULL) ORDER BY md5(CAST(id AS VARCHAR) || ':1'), id LIMIT 50")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Fifty pages nobody reviewed, at random."""
    return store.review_queue(pages_of(spark, d), load(spark, d, "quality_reviews"), 50).select("id", "url")


@query(f"SELECT page_id, idx, md5(text) AS text_hash FROM {CHUNKS} WHERE embedding IS NULL OR len(embedding) = 0 ORDER BY page_id, idx LIMIT 100")
def embed_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred chunks that wait for a vector."""
    return store.embed_queue(chunks_of(spark, d), pages_of(spark, d), 100).select("page_id", "idx", F.md5("text").alias("text_hash"))


@query(f"""WITH x AS (SELECT id, text_content AS t FROM {LATEST} WHERE id NOT IN (SELECT page_id FROM chunks WHERE len(embedding) > 0) ORDER BY id LIMIT 100), u AS (SELECT id, unnest(string_split(coalesce(t, ''), chr(10))) AS p, generate_subscripts(string_split(coalesce(t, ''), chr(10)), 1) AS i FROM x)
  SELECT id AS page_id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS idx, md5({TRIM.format('p')}) AS text_hash FROM u WHERE strlen({TRIM.format('p')}) > 20""")
def embed_queue_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Where no chunk waits, the first hundred pages without chunks are cut."""
    return store.embed_queue(chunks_of(spark, d).filter(vectors.present(F.col("embedding"))), pages_of(spark, d), 100).select("page_id", "idx", F.md5("text").alias("text_hash"))


@query(f"WITH p AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE len(embedding) > 0) AS has FROM {CHUNKS} GROUP BY page_id) SELECT (SELECT count(*) FROM p) AS complete, (SELECT count(*) FROM p WHERE has < n) AS completed_now")
def embedding_submit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for all chunks that wait; how many pages are complete then, and how many by it."""
    chunks = chunks_of(spark, d)
    batch = chunks.filter(~vectors.present(F.col("embedding"))).select("id", F.array(*[F.lit(float(i == 0)) for i in range(DIM)]).cast("array<float>").alias("embedding"))
    after, _ = store.submit_vectors(chunks, batch, DIM)
    by_page = lambda df: df.groupBy("page_id").agg(F.bool_and(vectors.present(F.col("embedding"))).alias("ok"))
    both = by_page(after).join(by_page(chunks).withColumnRenamed("ok", "before"), "page_id")
    return both.agg(F.count_if("ok").alias("complete"), F.count_if(F.col("ok") & ~F.col("before")).alias("completed_now"))


@query(f"SELECT id FROM {LATEST} WHERE id IN (SELECT page_id FROM chunks WHERE len(embedding) > 0) AND id NOT IN (SELECT page_id FROM {CHUNKS} GROUP BY page_id HAVING bool_and(coalesce(len(embedding), 0) > 0))")
def pages_lacking_vector(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a vector of their own though some of their chunks have one."""
    chunks = chunks_of(spark, d)
    whole = chunks.groupBy("page_id").agg(F.bool_and(vectors.present(F.col("embedding"))).alias("ok")).filter("ok").select("page_id")
    return store.lacking_vectors(pages_of(spark, d), whole, chunks).select("id")


@query(f"SELECT id, compilable OR coalesce(license_type, '') <> '' AS compilable FROM {LATEST}")
def compilable_flag(spark: SparkSession, d: str) -> DataFrame:
    """The flag set on all pages with a licence."""
    pages = pages_of(spark, d).select("id", "compilable", "license_type")
    return tables.set_columns(pages, pages.filter(F.coalesce("license_type", F.lit("")) != "").select("id", F.lit(True).alias("compilable")), "id").select("id", "compilable")


@query("SELECT lower(trim(type)) AS type, count(*) AS n FROM (SELECT type FROM contributions UNION ALL SELECT 'review' FROM quality_reviews) GROUP BY 1")
def contribution_log(spark: SparkSession, d: str) -> DataFrame:
    """Contributions with one row more for each review."""
    rows = load(spark, d, "contributions").select("type").unionByName(load(spark, d, "quality_reviews").select(F.lit("review").alias("type")))
    return rows.groupBy(F.lower(F.trim("type")).alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN consecutive_failures >= 3 THEN 'gone' WHEN consecutive_failures > 0 THEN 'failed' WHEN last_validated IS NULL THEN 'never' ELSE 'kept' END AS action, count(*) AS n FROM {LATEST} GROUP BY 1")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pages by what their last validation came to."""
    f = F.col("consecutive_failures")
    action = F.when(f >= 3, "gone").when(f > 0, "failed").when(F.col("last_validated").isNull(), "never").otherwise("kept")
    return pages_of(spark, d).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT url, count(*) AS inbound, 0 AS depth FROM search_results WHERE url <> '' AND url NOT IN (SELECT url FROM pages WHERE quality > 0.5) GROUP BY url")
def links_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are no page yet, for the frontier."""
    found = load(spark, d, "search_results").select(F.col("query_id").alias("page_id"), F.col("url").alias("href"))
    return graph.links_to_frontier(found, load(spark, d, "pages").filter("quality > 0.5"))


@query(f"""WITH f AS (SELECT l.id, from_page_id AS s, p.url AS href, anchor_text FROM links l JOIN {LATEST} p ON to_page_id = p.id), e AS (SELECT f.id, s, q.id AS t, anchor_text FROM f JOIN {LATEST} q ON q.url = href WHERE s <> q.id)
  SELECT s AS from_page_id, t AS to_page_id, arg_min(coalesce(anchor_text, '-'), (id, coalesce(anchor_text, '-'))) AS anchor_text FROM e GROUP BY 1, 2""")
def link_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Edges made anew from the addresses of all links, without self-links; of several the first anchor."""
    pages = pages_of(spark, d).select("id", "url")
    hrefs = load(spark, d, "links").join(pages.select(F.col("id").alias("to_page_id"), F.col("url").alias("href")), "to_page_id")
    found = hrefs.select(F.col("from_page_id").alias("page_id"), "href", F.coalesce("anchor_text", F.lit("-")).alias("anchor"), "id")
    return graph.links_to_pages(found, pages, keep_self=False, order="id")


@query(f"""WITH RECURSIVE v AS (SELECT DISTINCT id FROM {LATEST}), e AS (SELECT DISTINCT from_page_id AS src, to_page_id AS dst FROM links WHERE from_page_id IN (SELECT id FROM v) AND to_page_id IN (SELECT id FROM v)),
  r AS (SELECT min(id) AS id, 0 AS depth FROM v UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 6) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their distance from the first, up to six links."""
    ids = load(spark, d, "pages").select("id").distinct()
    return graph.breadth_first(stored(graph.valid_edges(ids, load(spark, d, "links")), "edges"), ids.agg(F.min("id").alias("id")), 6)


@query("SELECT id FROM contributions WHERE id NOT IN (SELECT id FROM contributions WHERE lower(trim(type)) = 'page') GROUP BY id")
def harvest_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Records that are not done: those of one kind were marked before, in files."""
    rows = load(spark, d, "contributions")
    progress = sources.Progress(spark, shared_path(spark, "progress"))
    progress.mark("id", rows.filter(F.lower(F.trim("type")) == "page"))
    return progress.unseen(rows, "id").select("id").distinct()


@query("SELECT type, count(*) AS n, count(contributor) AS n_named FROM contributions GROUP BY type")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Contributions written as JSON lines and read again."""
    path = shared_path(spark, "json")
    sources.to_json_lines(load(spark, d, "contributions"), path)
    rows = spark.read.schema("id long, type string, contributor string").json(path)
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count("contributor").alias("n_named"))


@query(f"SELECT id, license_type IS NOT NULL AND list_contains({literal(rules.SPDX_ACCEPTED)}, license_type) AS accepted FROM {LATEST}")
def spdx_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whether each page's licence type is an accepted SPDX id."""
    return pages_of(spark, d).select("id", licenses.spdx_accepted(F.col("license_type")).alias("accepted"))


@query(rf"SELECT id, md5(coalesce(title, '') || ' ' || array_to_string([w for w in regexp_split_to_array(coalesce(text_content, ''), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{2028}}\x{{3000}}]+') if w <> ''][1:500], ' ')) AS input_hash FROM {LATEST}")
def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of each page: title and first words."""
    return pages_of(spark, d).select("id", F.md5(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), texts.first_words(F.col("text_content")))).alias("input_hash"))


@query("WITH q AS (SELECT url, count(*) AS inbound FROM search_results GROUP BY url ORDER BY inbound DESC, url LIMIT 50) SELECT (SELECT count(*) FROM q) AS taken, (SELECT count(DISTINCT url) FROM search_results WHERE url NOT IN (SELECT url FROM q)) AS left_over")
def frontier_claim(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty of the frontier taken, the rest left."""
    taken, rest = tables.claim(tables.sightings(load(spark, d, "search_results"), F.col("url")), [F.desc("inbound"), F.col("url")], 50, "url")
    return taken.agg(F.count("*").alias("taken")).crossJoin(rest.agg(F.count("*").alias("left_over")))


@query(f"SELECT {DOMAIN} AS domain, count(*) AS n FROM {LATEST} WHERE {DOMAIN} IN (SELECT {DOMAIN} FROM {LATEST} WHERE consecutive_failures > 0 AND {DOMAIN} <> '' GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def learned_domain_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of domains that were learned from failures."""
    pages = pages_of(spark, d).select(urls.domain(F.col("url")).alias("domain"), F.when(F.col("consecutive_failures") > 0, F.lit("fetch failed")).alias("reason"))
    failing = quality.failing_domains(pages, "domain", "reason", 2)
    learned = store.learned_domains(failing, failing.limit(0))
    return pages.join(learned, "domain", "left_semi").groupBy("domain").agg(F.count("*").alias("n"))


@query(f"SELECT id FROM {LATEST} WHERE lower({HOST}) LIKE 'www.%' OR quality < 0.2")
def prune_policy(spark: SparkSession, d: str) -> DataFrame:
    """Pages to prune: of low quality, or not under their canonical URL."""
    canon = F.when(store.is_www_url(F.col("url")), F.lit("")).otherwise(F.col("url"))
    return store.prune_pages(pages_of(spark, d), F.coalesce(F.col("quality") < 0.2, F.lit(False)), canon).select("id")


@query("SELECT url, count(*) AS inbound FROM search_results WHERE url NOT IN (SELECT url FROM pages WHERE consecutive_failures > 0) GROUP BY url")
def frontier_reject(spark: SparkSession, d: str) -> DataFrame:
    """The frontier without the URLs of pages that failed."""
    return store.reject(tables.sightings(load(spark, d, "search_results"), F.col("url")), load(spark, d, "pages").filter("consecutive_failures > 0"))


@query(f"SELECT c.id FROM {CHUNKS} c JOIN {LATEST} p ON page_id = p.id WHERE len(embedding) > 0 AND quality > 0 AND quality < 0.3")
def vectors_to_evict(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of pages of low quality."""
    low = pages_of(spark, d).filter("quality > 0 AND quality < 0.3").select(F.col("id").alias("page_id"))
    return chunks_of(spark, d).filter(vectors.present(F.col("embedding"))).join(low, "page_id", "left_semi").select("id")


@query(f"SELECT id, round((1 - pow(0.5, date_diff('day', CAST(crawled_at AS DATE), DATE '2026-01-01') / 90.0)) * pagerank, 9) AS priority FROM {LATEST} WHERE pagerank IS NOT NULL")
def recrawl_priority(spark: SparkSession, d: str) -> DataFrame:
    """How urgent a new fetch of each page is on a fixed day."""
    days = F.datediff(F.lit("2026-01-01").cast("date"), F.col("crawled_at").cast("date"))
    return pages_of(spark, d).filter("pagerank IS NOT NULL").select("id", F.round((1 - texts.freshness(days)) * F.col("pagerank"), 9).alias("priority"))


_CENTRES = f"""e AS (SELECT page_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM {CHUNKS} WHERE {USABLE}), m AS (SELECT page_id, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY page_id, i), c AS (SELECT page_id, list(x ORDER BY i) AS v FROM m GROUP BY page_id),
  q AS (SELECT id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM {CHUNKS} WHERE id % 100 = 0 AND {USABLE} AND len([x for x in embedding if x <> 0]) > 0)"""


@query(f"WITH {_CENTRES} SELECT query_id, page_id, round(list_cosine_similarity(c.v, q.v), 6) AS similarity FROM c, q WHERE len([x for x in c.v if x <> 0]) > 0 AND list_cosine_similarity(c.v, q.v) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(c.v, q.v) DESC, page_id) <= 100")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """The hundred pages whose own vectors are most similar to each query vector."""
    chunks = chunks_of(spark, d)
    usable = chunks.filter(search.usable(F.col("embedding"), DIM))
    found = search.page_pool(vectors.centroids(usable, "page_id", "embedding", DIM), query_vectors(chunks), DIM, 20)
    return found.select("query_id", "page_id", F.round("similarity", 6).alias("similarity"))


@query()
def search_request(spark: SparkSession, d: str) -> DataFrame:
    """The whole request for each query vector: chunk search, page vectors where it gives nothing, compilable results alone, with their number."""
    chunks = chunks_of(spark, d)
    found = search.request(chunks, pages_of(spark, d), query_vectors(chunks), DIM, 20, compilable_only=True)
    return found.withColumns({"similarity": F.round("similarity", 6), "final_score": F.round("final_score", 6)})


# --- functions over cases written out

_URLS = [
    # url, without fragment, forge owner, forge repository, wiki title, wikipedia, tier
    ("https://ex.org/a/b/#top", "https://ex.org/a/b", "a", "b", None, False, 4),
    ("https://github.com/own/repo/tree/x?tab=1", "https://github.com/own/repo/tree/x?tab=1", "own", "repo", None, False, 4),
    ("https://codeberg.org/own", "https://codeberg.org/own", "", "", None, False, 4),
    ("https://en.wikipedia.org/wiki/Category_theory#History", "https://en.wikipedia.org/wiki/Category_theory", "wiki", "Category_theory", "Category_theory", True, 4),
    ("https://de.wikipedia.org/wiki/Haus", "https://de.wikipedia.org/wiki/Haus", "wiki", "Haus", None, True, 4),
    ("http://www.rfc-editor.org/rfc/", "http://www.rfc-editor.org/rfc", "", "", None, False, 1),
    ("https://some.pressbooks.pub/x", "https://some.pressbooks.pub/x", "", "", None, False, 3),
    ("https://ecfr.gov", "https://ecfr.gov", "", "", None, False, 2),
]


@query(expected("url, plain, owner, repo, title, is_wikipedia, tier", _URLS))
def url_cases(spark: SparkSession, d: str) -> DataFrame:
    """Parts of addresses: fragment, forge, wiki title, tier."""
    u = F.col("url")
    return spark.createDataFrame([(r[0],) for r in _URLS], "url string").select(
        u, urls.without_fragment(u).alias("plain"), urls.forge_owner(u).alias("owner"), urls.forge_repo(u).alias("repo"), urls.wiki_title(u).alias("title"), urls.is_wikipedia(urls.domain(u)).alias("is_wikipedia"), store.domain_tier(u, rules.DOMAIN_TIERS).alias("tier")
    )


_NORMAL = [
    ("https://ex.org/p?share=1&id=2", "https://ex.org/p?id=2", "https://ex.org/p?id=2"),
    ("http://ex.org/p/?utm_source=a&utm_medium=b", "https://ex.org/p", "http://ex.org/p/"),
    ("https://ex.org/p?page=3", "https://ex.org/p?page=3", "https://ex.org/p?page=3"),
    ("https://www.ex.org/p#f", "https://www.ex.org/p", "https://ex.org/p#f"),
    ("https://github.com/Own/Repo/blob/main/x.py?fbclid=1", "https://github.com/Own/Repo", "https://github.com/Own/Repo"),
    ("https://ex.org/p?b=2&a=x%20y&gclid=1", "https://ex.org/p?a=x+y&b=2", "https://ex.org/p?a=x+y&b=2"),
]


@query(expected("url, normal, canonical", _NORMAL))
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normalised and canonical addresses, forges and escapes included."""
    u = F.col("url")
    return spark.createDataFrame([(r[0],) for r in _NORMAL], "url string").select(u, urls.normalise(u).alias("normal"), urls.canonical(u).alias("canonical"))


_LINKS = [
    ("https://ex.org/a/b", "c", "https://ex.org/a/c"), ("https://ex.org/a/b", "/c#x", "https://ex.org/c"), ("https://ex.org/a/b", "../c?q=1", "https://ex.org/c?q=1"), ("https://ex.org/a/b", "//o.org/x", "https://o.org/x"),
    ("https://ex.org/a/b", "http://o.org/y", "http://o.org/y"), ("https://ex.org/a/b", "mailto:x@y", None), ("https://ex.org", "c", "https://ex.org/c"),
]


@query(expected("base, href, target", _LINKS))
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links against the page they stand on."""
    return spark.createDataFrame([r[:2] for r in _LINKS], "base string, href string").select("base", "href", urls.resolve_link(F.col("base"), F.col("href")).alias("target"))


_SA, _GPL = "https://creativecommons.org/licenses/by-sa/4.0/", "https://www.gnu.org/licenses/gpl-3.0.html"
_HTML = [
    # name, html, licence, links
    ("link", f'<link rel="license" href="{_SA}"><p><a href="/x/">x y</a></p>', "CC BY-SA", ["https://ex.org/x|x y"]),
    ("anchor", f'<p><a rel="license" href="{_GPL}">licence</a></p>', "GPL-3.0", [f"{_GPL}|licence"]),
    ("meta", '<meta name="dc.rights" content="https://www.mozilla.org/MPL/2.0/">', "MPL", []),
    ("json", f'<script type="application/ld+json">{{"license": "{_SA}"}}</script>', "CC BY-SA", []),
    ("footer", "<footer><a href='/l#a'>CC0 1.0</a></footer>", "CC0", ["https://ex.org/l|CC0 1.0"]),
    ("no footer", "<p><a href='mailto:a@b'>CC0</a></p>", None, []),
    ("old", "<a rel='license' href='https://www.gnu.org/licenses/gpl-2.0.html'>g</a>", None, ["https://www.gnu.org/licenses/gpl-2.0.html|g"]),
]


@query(expected("name, license, links", [(r[0], r[2], "; ".join(r[3])) for r in _HTML]))
def html_cases(spark: SparkSession, d: str) -> DataFrame:
    """Licence and links of pages by each of the finders."""
    df = spark.createDataFrame([r[:2] for r in _HTML], "name string, html string").withColumn("p", markup.html_page(F.col("html"), F.lit("https://ex.org/")))
    return df.select("name", F.col("p.license.type").alias("license"), F.array_join(F.transform("p.links", lambda x: F.concat(x["href"], F.lit("|"), x["anchor"])), "; ").alias("links"))


_SPDX = [(x, True) for x in rules.SPDX_ACCEPTED] + [(x, False) for x in ("GPL-2.0", "GPL-2.0-only", "LGPL-2.1", "GFDL-1.3", "MIT", "Apache-2.0", "BSD-3-Clause", "", "gpl-3.0")]


@query(expected("spdx, accepted", _SPDX))
def spdx_cases(spark: SparkSession, d: str) -> DataFrame:
    """Which SPDX ids are accepted."""
    return spark.createDataFrame([(r[0],) for r in _SPDX], "spdx string").select("spdx", licenses.spdx_accepted(F.col("spdx")).alias("accepted"))


_ARCHIVE = [("cc-by-sa-4.0", "CC BY-SA", 1), ("cc-zero", "CC0", 3), ("mit", None, None)]


@query(expected("license, kind, biggest", [(a, k, b) for a, k, b in _ARCHIVE]))
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of an archive from JSON: licence, and the place of the largest PDF under the cap."""
    files = [[(1, "a.pdf", 5), (2, "b.txt", 9)], [(1, "a.pdf", 5), (2, "b.PDF", 99 << 20), (3, "c.PDF", 7)], [(1, "x.zip", 1)]]
    lines = [
        f'{{"id": {i}, "metadata": {{"license": {{"id": "{a}"}}}}, "files": [' + ", ".join(f'{{"key": "{n}", "size": {s}, "links": {{"self": "{k}"}}}}' for k, n, s in f) + "]}"
        for i, ((a, _, _), f) in enumerate(zip(_ARCHIVE, files, strict=True))
    ]
    path = shared_path(spark, "records")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    rows = sources.records(spark, path)
    return rows.select(F.col("metadata.license.id").alias("license"), licenses.archive_license(F.col("metadata.license.id"))["type"].alias("kind"), sources.largest_file(F.col("files"))["links"]["self"].cast("int").alias("biggest"))


_SEEDS = ["https://a.org/1", "https://a.org/2?x=1&y=2", "https://b.org/1", "https://b.org/2", "https://c.org/1"]


def _set(*locs: str, index: bool = False) -> str:
    tag = "sitemapindex" if index else "urlset"
    return f'<?xml version="1.0"?><{tag} xmlns="x">' + "".join(f"<url><loc> {x.replace('&', '&amp;')} </loc></url>" for x in locs) + f"</{tag}>"


@query(expected("url", [(x,) for x in _SEEDS]))
def sitemap_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Pages that the sitemaps of three origins name: by robots.txt, through an index, gzipped, and at the usual place; broken and missing ones are skipped."""
    robots = spark.createDataFrame([("https://a.org", "User-agent: *\nSitemap: https://a.org/s.xml\nsitemap: https://a.org/gone.xml"), ("https://b.org", None), ("https://c.org", "Disallow: /")], "origin string, body string")
    fetched = [
        ("https://a.org/s.xml", _set(*_SEEDS[:2]).encode()), ("https://b.org/sitemap.xml", _set("https://b.org/s1.xml.gz", "https://b.org/s2.xml", "https://b.org/bad.gz", index=True).encode()),
        ("https://b.org/s1.xml.gz", gzip.compress(_set(_SEEDS[2]).encode())), ("https://b.org/s2.xml", _set(_SEEDS[3]).encode()), ("https://b.org/bad.gz", b"\x1f\x8bbroken"), ("https://c.org/sitemap.xml", _set(_SEEDS[4]).encode()), ("https://x.org/sitemap.xml", _set("https://x.org/1").encode()),
    ]
    return sources.sitemap_pages(spark.createDataFrame([(u, bytearray(b)) for u, b in fetched], "url string, body binary"), sources.sitemap_sources(robots))


_GATE = [("https://a.org/x/1", False), ("https://a.org/y", True), ("https://a.org/x/ok/2", True), ("https://b.org/x", True), ("not a url", True)]


@query(expected("url, allowed", _GATE))
def robots_gate(spark: SparkSession, d: str) -> DataFrame:
    """Addresses held against the robots.txt of their origin."""
    robots = spark.createDataFrame([("https://a.org", "User-agent: *\nAllow: /x/ok\nDisallow: /x")], "origin string, body string")
    return sources.robots_gate(spark.createDataFrame([(u,) for u, _ in _GATE], "url string"), robots, "bot")


_FETCHES = [
    ("https://a.org/1", "https://www.a.org/1", 200, "text/html; charset=utf-8", 10, "ok"), ("https://a.org/2", None, 404, "text/html", 10, "status"), ("https://a.org/3", "https://b.org/3", 200, "text/html", 10, "redirect"),
    ("https://a.org/4", None, 200, "application/pdf", 10, "kind"), ("https://a.org/5", None, 200, "text/html", 6 << 20, "size"), ("https://a.org/6", None, None, None, None, "status"), ("https://a.org/7", None, 200, None, 1, "kind"),
]


@query(expected("url, verdict", [(r[0], r[5]) for r in _FETCHES]))
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Fetches by what is wrong with them."""
    return sources.fetch_verdict(spark.createDataFrame([r[:5] for r in _FETCHES], "url string, final_url string, status int, content_type string, size long")).select("url", "verdict")


_JSON = [("[0.5, 1, -2]", 3, -0.5), ("[]", None, None), ("null", None, None), ("[1, x", None, None), (None, None, None), ("[4]", 1, 4.0)]


@query(expected("text, n, total", [r for r in _JSON]))
def json_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from JSON lists."""
    v = sources.vector_of_json(F.col("text"))
    return spark.createDataFrame([(r[0],) for r in _JSON], "text string").select("text", F.when(v.isNotNull(), F.size(v)).alias("n"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))


_TEXTS = [("ab\ncd\nef", 7, "ab\ncd"), ("abc", 7, "abc"), ("abcdefghij", 7, "abcdefg"), ("", 7, ""), ("éé\nxyz", 6, "éé")]


@query(expected("text, kept", [(r[0], r[2]) for r in _TEXTS]))
def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at their last line end before a limit of bytes."""
    parts = [spark.createDataFrame([(t,)], "text string").select("text", texts.cut_at_line(F.col("text"), n).alias("kept")) for t, n, _ in _TEXTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LIMITS = [(None, 20), (0, 20), (1, 1), (100, 100), (101, 20), (-3, 20)]


@query(expected("asked, given", _LIMITS))
def limit_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Limits as they are granted."""
    return spark.createDataFrame([(r[0],) for r in _LIMITS], "asked int").select("asked", store.clamped(F.col("asked"), 20).alias("given"))


@query("SELECT n, p, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(greatest(1, round(ceil(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2))) AS INTEGER) AS hashes FROM (SELECT CAST(n AS BIGINT) AS n, CAST(p AS DOUBLE) AS p FROM (VALUES (1000000, 0.0001), (5000000, 0.001), (10, 0.5), (1, 0.9)) t(n, p))")
def bloom_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bits and hashes of Bloom filters."""
    bits, hashes = store.bloom_size(F.col("n"), F.col("p"))
    return spark.createDataFrame([(1_000_000, 0.0001), (5_000_000, 0.001), (10, 0.5), (1, 0.9)], "n long, p double").select("n", "p", bits.cast("long").alias("bits"), hashes.alias("hashes"))


_LISTED = ["ex.org", "b.org", "c.org"]


@query(expected("value", [(x,) for x in _LISTED]))
def list_file(spark: SparkSession, d: str) -> DataFrame:
    """A list file without comments and blank lines."""
    path = shared_path(spark, "list")
    spark.createDataFrame([(x,) for x in ("# domains", " ex.org ", "", "b.org", "\t", "c.org", "#x")], "value string").write.text(path)
    return sources.line_list(spark, path)
