"""URL algebra as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainfield import rules

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, authority, path, query or fragment of a URL, '' where absent."""
    return F.regexp_extract(url, _PARTS, ("scheme", "authority", "path", "query", "fragment").index(name) + 1)


def parsable(url: Column) -> Column:
    """False for control characters, broken percent escapes in the path, and hosts with spaces or brackets left open."""
    control = url.rlike(r"[\x00-\x1f\x7f]")
    escape = part(url, "path").rlike(r"%(?![0-9A-Fa-f]{2})")
    return ~(control | escape | part(url, "authority").rlike(r"[\s<>\"]|^[^\[]*\]|\[[^\]]*$") | url.rlike(r"^:"))


def host(url: Column) -> Column:
    """Host without user and port, spelled as it stands."""
    return F.regexp_extract(part(url, "authority"), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)


def domain(url: Column) -> Column:
    """Lower-case host without one leading www.; '' where the URL has none or cannot be parsed."""
    return F.coalesce(F.when(parsable(url), F.regexp_replace(F.lower(host(url)), r"^www\.", "")), F.lit(""))


def display_domain(url: Column) -> Column:
    """Host as spelled, without www. where more is left than that."""
    h = host(url)
    return F.coalesce(F.when(h.startswith("www.") & (F.length(h) > 4), F.substring(h, 5, 1_000_000)).otherwise(h), F.lit(""))


def _joined(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when((authority != "") | (scheme != ""), F.concat(F.lit("//"), authority)).otherwise(""), path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _escaped(x: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(x), x)
    return F.regexp_replace(F.regexp_replace(F.url_encode(plain), r"\*", "%2A"), "%7E", "~")


def _clean_query(query: Column, params: Sequence[str]) -> Column:
    """A query without tracking parameters; if any was there, the rest sorted by key and escaped anew, else as it stands."""
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    key = lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))
    kept = F.filter(pieces, lambda p: ~key(p).isin(*params))
    keyed = F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), F.concat(_escaped(F.substring_index(p, "=", 1)), F.lit("="), _escaped(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))).alias("p")))
    return F.when(F.size(kept) == F.size(pieces), query).otherwise(F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&"))


def strip_tracking(url: Column, params: Sequence[str] = rules.TRACKING_PARAMS) -> Column:
    """The URL without tracking parameters."""
    query = part(url, "query")
    clean = _clean_query(query, params)
    rebuilt = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""), F.regexp_extract(url, r"(#.*)$", 1))
    return F.when((query == "") | ~parsable(url), url).otherwise(rebuilt)


def is_forge(url: Column, forges: Sequence[str] = rules.FORGES) -> Column:
    return F.lower(host(url)).isin(*forges) & (forge_owner(url) != "") & (forge_repo(url) != "")


def forge_owner(url: Column) -> Column:
    return F.regexp_extract(part(url, "path"), r"^/*([^/]+)/([^/]+)", 1)


def forge_repo(url: Column) -> Column:
    return F.regexp_extract(part(url, "path"), r"^/*([^/]+)/([^/]+)", 2)


def normalise(url: Column) -> Column:
    """One spelling for a page: no fragment, trailing slash or tracking, https for http, forge pages as owner/repository; '' if unparsable."""
    path = F.regexp_replace(part(url, "path"), "/+$", "")
    path = F.when(is_forge(url), F.concat(F.lit("/"), forge_owner(url), F.lit("/"), forge_repo(url))).otherwise(path)
    scheme = F.when(F.lower(part(url, "scheme")) == "http", F.lit("https")).otherwise(part(url, "scheme"))
    return F.when(parsable(url), _joined(scheme, part(url, "authority"), path, _clean_query(part(url, "query"), rules.TRACKING_PARAMS), F.lit(""))).otherwise("")


def canonical(url: Column) -> Column:
    """The URL under which a page is kept: tracking and a leading www. removed, forge pages as owner/repository; scheme, slash and fragment stay."""
    plain = strip_tracking(url)
    bare = F.regexp_replace(F.lower(part(plain, "authority")), r"^((?:.*@)?)www\.", "$1")
    moved = _joined(part(plain, "scheme"), bare, part(plain, "path"), part(plain, "query"), part(plain, "fragment"))
    forge = F.concat(F.lit("https://"), domain(plain), F.lit("/"), forge_owner(plain), F.lit("/"), forge_repo(plain))
    return F.when(is_forge(plain), forge).when(parsable(plain) & F.lower(host(plain)).startswith("www."), moved).otherwise(plain)


def without_fragment(url: Column) -> Column:
    """Fragment and trailing slashes of the path removed, nothing else."""
    return _joined(part(url, "scheme"), part(url, "authority"), F.regexp_replace(part(url, "path"), "/+$", ""), part(url, "query"), F.lit(""))


def resolve_link(base: Column, href: Column) -> Column:
    """A link against its page, http(s) only, without fragment; null where it leads nowhere."""
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme, authority = part(base, "scheme"), part(base, "authority")
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(part(base, "path"), "[^/]*$", "")
    path = F.when(link.startswith("/"), F.regexp_extract(link, "^([^?]*)", 1)).when(F.regexp_extract(link, "^([^?]*)", 1) == "", part(base, "path")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(link, "^([^?]*)", 1)))
    steps = F.aggregate(
        F.split(path, "/", -1), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    folderish = F.when(path.rlike(r"/\.{1,2}$"), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    flat = F.concat(root, F.regexp_replace(F.array_join(folderish, "/"), "^/*", "/"), F.regexp_extract(link, r"(\?.*)$", 1))
    absolute = F.when(F.lower(link).rlike("^https?://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(flat)
    return F.when(parsable(link), absolute)


def is_binary(url: Column, suffixes: Sequence[str] = rules.BINARY_SUFFIXES) -> Column:
    pattern = "(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    return F.coalesce(parsable(url) & F.lower(part(url, "path")).rlike(pattern), F.lit(False))


def has_prefix(url: Column, prefixes: Sequence[str]) -> Column:
    """Whether the path begins with one of the prefixes."""
    test = F.lit(False)
    for p in prefixes:
        test = test | part(url, "path").startswith(p)
    return F.coalesce(parsable(url) & test, F.lit(False))


def is_wiki_meta(url: Column) -> Column:
    return has_prefix(url, rules.WIKI_META_PREFIXES)


def is_wiki_action(url: Column) -> Column:
    first = F.regexp_extract(part(url, "query"), r"(?:^|&)action=([^&]*)", 1)
    return F.coalesce(parsable(url) & F.coalesce(F.try_url_decode(first), first).isin(*rules.WIKI_ACTIONS), F.lit(False))


def is_foreign_wiki(name: Column) -> Column:
    """A wiki project's host in another language than English; the bare project is none."""
    test = F.lit(False)
    for p in rules.WIKI_PROJECTS:
        test = test | (name.endswith(p) & (name != f"en{p}"))
    return F.coalesce(test, F.lit(False))


def is_wikipedia(name: Column) -> Column:
    return F.coalesce((name == "wikipedia.org") | name.endswith(".wikipedia.org"), F.lit(False))


def wiki_title(url: Column, hosts: Sequence[str] = ("en.wikipedia.org", "en.wikibooks.org", "en.wikisource.org")) -> Column:
    """Title of an English wiki article, else null."""
    title = F.regexp_extract(part(url, "path"), "^/wiki/(.+)$", 1)
    return F.when(F.lower(host(url)).isin(*hosts) & (title != ""), title)


def suffixes_of(name: Column) -> Column:
    """A domain and all domains above it, for an equi-join with a list of domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
