"""Sources and sinks: line lists, JSON records, fetched bodies, sitemaps, versioned tables, progress."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grainfield.functions import texts, urls
from grainfield.session import load, stored

#: JSON of an archive's records, as far as it is read.
RECORD_SCHEMA = "id long, metadata struct<title:string, license:struct<id:string>, access_right:string>, files array<struct<key:string, size:long, links:struct<self:string>>>"


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a list file, trimmed, without blank lines and those that begin with #."""
    return spark.read.text(path).select(texts.trimmed(F.col("value")).alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Archive records, one JSON document a line; malformed ones have null fields."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def largest_file(files, suffix: str = ".pdf", most_bytes: int = 30 << 20):
    """The largest file of a record with the suffix and at most so many bytes; of equal ones the first."""
    fit = F.filter(files, lambda f: F.lower(f["key"]).endswith(suffix) & (f["size"] <= most_bytes))
    ranked = F.transform(fit, lambda f, i: F.struct(f["size"].alias("s"), (-i).alias("i"), f.alias("f")))
    return F.array_max(ranked)["f"]


def vector_of_json(text):
    """array<double> of a JSON list; null for null, [] and malformed text."""
    v = F.from_json(text, "array<double>")
    return F.when(F.size(v) > 0, v)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """One version of a table in a folder of its own, so that readers never see a half-written one."""
    path = f"{root.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def to_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """The tables of a folder as views, for SQL."""
    for n in names:
        load(spark, folder, n).createOrReplaceTempView(n)


def fetch_verdict(fetches: DataFrame, kinds: tuple[str, ...] = ("html",), most_bytes: int = 5 << 20) -> DataFrame:
    """Fetches (url, final_url, status, content_type, size) with `verdict`: ok, or the first of status, redirect, kind and size that is wrong.

    A redirect is wrong if it leaves the domain; a null size is no reason.
    """
    moved = urls.domain(F.coalesce("final_url", "url")) != urls.domain(F.col("url"))
    kind = texts.content_kind(F.col("content_type"))
    wrong = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "status").when(moved, "redirect").when(F.coalesce(~kind.isin(*kinds), F.lit(True)), "kind").when(F.col("size") > most_bytes, "size")
    return fetches.withColumn("verdict", F.coalesce(wrong, F.lit("ok")))


@F.pandas_udf(StringType())
def unzipped(body: pd.Series) -> pd.Series:
    """The text of a body that may be gzipped; null for null and for broken ones."""

    def one(x: bytes | None) -> str | None:
        try:
            return None if x is None else (gzip.decompress(x) if bytes(x[:2]) == b"\x1f\x8b" else bytes(x)).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return body.map(one)


def sitemap_sources(robots: DataFrame) -> DataFrame:
    """(origin, sitemap): the sitemaps that each origin's robots.txt (origin, body) names, else its /sitemap.xml."""
    named = texts.sitemap_directives(F.col("body"))
    return robots.select("origin", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.concat("origin", F.lit("/sitemap.xml"))))).alias("sitemap")).distinct()


def sitemap_pages(fetched: DataFrame, roots: DataFrame, most_bytes: int = 10 << 20, depth: int = 5) -> DataFrame:
    """(url): pages named by the sitemaps of `roots` (sitemap) and by those that their indexes name, `depth` levels down.

    `fetched` has (url, body binary), gzipped or not; bodies over the cap and sitemaps that were not fetched are skipped, the others go on.
    """
    text = unzipped(F.when(F.octet_length("body") <= most_bytes, F.col("body")))
    known = stored(fetched.select(F.col("url").alias("sitemap"), text.alias("xml")).filter("xml IS NOT NULL").select("sitemap", F.col("xml").rlike("<sitemapindex[\\s>]").alias("index"), texts.sitemap_urls(F.col("xml")).alias("locs")), "sitemaps")
    level, pages = roots.select("sitemap").distinct(), None
    for _ in range(depth):
        here = stored(known.join(level, "sitemap", "left_semi"), "level")
        found = here.filter("NOT index").select(F.explode("locs").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        level = here.filter("index").select(F.explode("locs").alias("sitemap")).distinct()
        if here.filter("index").isEmpty():
            break
    return pages.distinct()


def robots_gate(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """`pages` with `allowed`: the rules (origin, body) of each URL's origin on its path; true where there are none or the URL has no origin."""
    origin = F.concat(urls.part(F.col("url"), "scheme"), F.lit("://"), urls.part(F.col("url"), "authority"))
    rules_ = robots.groupBy(F.col("origin").alias("_origin")).agg(F.min("body").alias("_body")).select("_origin", texts.robots_rules(F.col("_body")).alias("_rules"))
    allowed = F.when(F.col("_rules").isNotNull() & urls.parsable(F.col("url")), texts.robots_allows(F.col("_rules"), urls.part(F.col("url"), "path"), agent))
    return pages.join(rules_, origin == F.col("_origin"), "left").select(*pages.columns, F.coalesce(allowed, F.lit(True)).alias("allowed"))


class Progress:
    """What a job has done, as ids in append-only files in a shared folder, with a cursor; a run that is lost repeats at most its last batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.done_path, self.cursor_path = spark, f"{root.rstrip('/')}/done", f"{root.rstrip('/')}/cursor"

    def _read(self, path: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def done(self) -> DataFrame:
        return self._read(self.done_path, "id long").distinct()

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key is not done yet; rows of null key stay."""
        return rows.join(self.done().select(F.col("id").alias("_done")), F.col(key) == F.col("_done"), "left_anti")

    def mark(self, ids: Column | str, rows: DataFrame) -> None:
        rows.select(ids if isinstance(ids, Column) else F.col(ids)).toDF("id").write.mode("append").parquet(self.done_path)

    def cursor(self) -> int:
        """How far the source was read; 0 at the start."""
        return self._read(self.cursor_path, "at long").agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]

    def advance(self, at: int) -> None:
        self.spark.createDataFrame([(at,)], "at long").write.mode("append").parquet(self.cursor_path)
