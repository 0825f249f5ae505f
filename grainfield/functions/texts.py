"""Text functions as column expressions; lengths are of UTF-8 bytes where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column, more_than_bytes: int = 20) -> Column:
    """Trimmed lines of more than so many bytes."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), trimmed), lambda p: F.octet_length(p) > more_than_bytes)


def first_words(text: Column, n: int = 500) -> Column:
    """The first n words, with single spaces."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def byte_prefix(text: Column, n: int) -> Column:
    """At most n bytes of a text, never cutting a character."""
    raw = F.encode(text, "UTF-8")
    parted = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")  # noqa: E731  the byte after k goes on with a character
    cut = F.when(~parted(n), n).when(~parted(n - 1), n - 1).when(~parted(n - 2), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def snippet(text: Column, n: int = 200) -> Column:
    """The beginning of a text, marked with dots where more follows."""
    return F.when(F.octet_length(text) > n, F.concat(byte_prefix(text, n), F.lit("..."))).otherwise(text)


def cut_at_line(text: Column, most_bytes: int) -> Column:
    """A text over the limit ends at its last line break before it."""
    head = byte_prefix(text, most_bytes)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.when(head.contains("\n"), F.regexp_replace(head, r"(?s)\n[^\n]*$", "")).otherwise(head))


def content_kind(content_type: Column) -> Column:
    """pdf, html, text or null by a Content-Type header."""
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(c.contains("application/pdf"), "pdf").when(c.contains("text/html") | c.contains("application/xhtml"), "html").when(c.contains("text/plain") | c.contains("text/markdown"), "text")


def structural_score(text: Column) -> Column:
    """Signs of worked material: code, formulas, citations, examples, headings and list items, added up."""
    marks = (r"(?m)^```|(?m)^    \S", r"\$[^$\n]+\$|=", r"\[\d+\]|\((?:19|20)\d\d\)", r"(?i)\b(?:example|exercise)\b", r"(?m)^#{1,6} ", r"(?m)^\s*(?:[-*•]|\d+\.) ")
    t = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for m in marks:
        total = total + F.regexp_count(t, F.lit(m))
    return total


def fingerprint(address: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of an address."""
    return F.substring(F.sha2(address, 256), 1, 16)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def freshness(days: Column, half_life: float = 90.0) -> Column:
    """1 when just fetched, halved every half-life."""
    return F.pow(F.lit(0.5), days / half_life)


def robots_rules(body: Column) -> Column:
    """array<struct<agent, allow, path>> of a robots.txt in file order; empty values and rules before any agent are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), trimmed), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(trimmed(F.substring_index(x, ":", 1))).alias("k"), trimmed(F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), r"\s#.*$", "")).alias("v")))
    start = F.struct(F.lit("").alias("agent"), F.array().cast("array<struct<agent:string,allow:boolean,path:string>>").alias("rules"))
    rule = lambda acc, x: F.struct(acc["agent"].alias("agent"), (x["k"] == "allow").alias("allow"), x["v"].alias("path"))
    step = lambda acc, x: F.when(x["k"] == "user-agent", F.struct(F.lower(x["v"]).alias("agent"), acc["rules"].alias("rules"))).when(
        x["k"].isin("allow", "disallow") & (x["v"] != "") & (acc["agent"] != ""), F.struct(acc["agent"].alias("agent"), F.concat(acc["rules"], F.array(rule(acc, x))).alias("rules"))
    ).otherwise(acc)
    return F.aggregate(pairs, start, step, lambda acc: acc["rules"])


def robots_allows(parsed: Column, path: Column, agent: str) -> Column:
    """Whether a path may be fetched: the agent's own rules if it has any, else those for *; the first that fits in file order decides."""

    def verdict(name: str) -> Column:
        own = F.filter(parsed, lambda r: r["agent"] == name)
        fits = F.filter(own, lambda r: path.startswith(r["path"]))
        return F.when(F.size(own) > 0, F.when(F.size(fits) > 0, F.element_at(fits, 1)["allow"]).otherwise(True))

    return F.coalesce(F.when(parsed.isNotNull(), F.coalesce(verdict(agent.lower()), verdict("*"))), F.lit(True))


def sitemap_urls(xml: Column) -> Column:
    """All <loc> of a sitemap or sitemap index, trimmed."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.regexp_replace(x, "&amp;", "&"))


def sitemap_directives(robots: Column) -> Column:
    """Sitemap addresses named in a robots.txt."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), "\r?\n"), trimmed)
    return F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), lambda x: trimmed(F.substring(x, 9, 1_000_000)))
