"""Column functions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from grainfield import rules
from grainfield.functions import licenses, markup, texts, urls, vectors


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalise(spark):
    cases = {
        "https://ex.org/a?share=x": "https://ex.org/a", "https://ex.org/a?utm_source=f&fbclid=1": "https://ex.org/a", "https://ex.org/a?id=5&page=2": "https://ex.org/a?id=5&page=2", "http://ex.org/a/?b=2&utm_id=1&a=1#top": "https://ex.org/a?a=1&b=2",
        "https://github.com/o/r/blob/main/f.py": "https://github.com/o/r", "https://www.github.com/o/r/x": "https://www.github.com/o/r/x", "https://ex.org": "https://ex.org", "https://ex.org/%zz": "",
    }
    assert column(spark, [*cases, None], urls.normalise) == [*cases.values(), ""]


def test_canonical_and_tracking(spark):
    assert column(spark, ["http://WWW.Ex.org/a/#x", "https://ex.org/a?gclid=1#x", "https://codeberg.org/o/r/issues?tab=1", "https://www.ex.org/?q=a b"], urls.canonical) == [
        "http://ex.org/a/#x", "https://ex.org/a#x", "https://codeberg.org/o/r", "https://ex.org/?q=a b",
    ]
    assert column(spark, ["https://ex.org/a?x=%41&ref=2", "https://ex.org/a?z=a b&_ga=1&y=%C3%A9"], urls.strip_tracking) == ["https://ex.org/a?x=%41&ref=2", "https://ex.org/a?y=%C3%A9&z=a+b"]


def test_domains_and_flags(spark):
    assert column(spark, ["https://www.Ex.org:80/x", "not a url", "https://u@ex.org", None, "https://a.b.ex.org/"], urls.domain) == ["ex.org", "", "ex.org", "", "a.b.ex.org"]
    assert column(spark, ["https://ex.org/a.PDF.zip", "https://ex.org/a?b=.zip", None], urls.is_binary) == [True, False, False]
    assert column(spark, ["https://x.org/wiki/Category:A", "https://x.org/wiki/Category_theory"], urls.is_wiki_meta) == [True, False]
    assert column(spark, ["https://x.org/w/i.php?title=A&action=edit", "https://x.org/?action=view"], urls.is_wiki_action) == [True, False]
    assert column(spark, ["de.wikipedia.org", "en.wikipedia.org", "wikipedia.org", None], urls.is_foreign_wiki) == [True, False, False, False]
    assert column(spark, ["a.b.org"], urls.suffixes_of) == [["a.b.org", "b.org", "org"]]
    assert column(spark, ["https://x.org/ebooks/subject/3"], lambda u: urls.has_prefix(u, rules.CATALOGUE_PREFIXES)) == [True]


def test_resolve_link_like_the_standard_library(spark):
    from urllib.parse import urljoin

    base = "https://ex.org/a/b/c?q=1"
    links = ["d", "/d/e", "../x", "./y/", "?p=2", "//other.org/z", "http://k.org/a", "../../../up", "..", "g#frag"]
    got = column(spark, [*links, "mailto:a@b.c", "javascript:void(0)"], lambda x: urls.resolve_link(F.lit(base), x))
    assert got == [urljoin(base, x).split("#")[0] for x in links] + [None, None]


def test_license_words(spark):
    cases = {
        "GNU Affero General Public License": "AGPL-3.0", "GNU General Public License Version 3": "GPL-3.0", "GNU General Public License version 2": "", "GNU Lesser General Public License version 3": "LGPL-3.0", "GNU Lesser General Public License 2.1": "",
        "Mozilla Public License": "MPL-2.0", "Creative Commons Attribution-ShareAlike": "CC-BY-SA-4.0", "creative commons cc0": "CC0-1.0", "This is public domain": "Unlicense", "not public domain": "", "All rights reserved": "",
    }
    assert column(spark, [*cases, None], licenses.license_of_text) == [*cases.values(), ""]
    assert column(spark, ["https://CreativeCommons.org/licenses/by-sa/4.0/", "https://creativecommons.org/licenses/by-nc-sa/4.0", "https://unlicense.org", None], licenses.license_of_url) == ["CC BY-SA", None, "Unlicense", None]
    assert column(spark, [" gplv3 ", "CC BY-NC"], licenses.license_of_footer) == ["GPL-3.0", None]


def test_texts(spark):
    assert column(spark, ["  short\n" + "x" * 21 + "  \n" + "é" * 10 + "\n" + "é" * 11, None], texts.paragraphs) == [["x" * 21, "é" * 11], []]
    assert column(spark, [" a  b\tc ", None, ""], lambda x: texts.first_words(x, 2)) == ["a b", "", ""]
    assert column(spark, ["é" * 101, "a" * 200], texts.snippet) == ["é" * 100 + "...", "a" * 200]
    assert column(spark, ["aé"], lambda x: texts.byte_prefix(x, 2)) == ["a"]
    assert column(spark, ["ab\ncd\nef", "abc"], lambda x: texts.cut_at_line(x, 7)) == ["ab\ncd", "abc"]
    assert column(spark, ["text/html; charset=x", "application/pdf", "image/png", None], texts.content_kind) == ["html", "pdf", None, None]


def test_robots(spark):
    body = "# c\nDisallow: /early\nUser-agent: Bot\nAllow: /a/b # ok\nDisallow: /a\nUser-agent: *\nDisallow: /\nDisallow:\nSitemap: https://ex.org/s.xml\n"
    df = spark.createDataFrame([(body, p) for p in ("/a/b/c", "/a/x", "/z")] + [(None, "/z")], "b string, p string").select(texts.robots_rules(F.col("b")).alias("r"), "p", "b")
    rows = df.select(texts.robots_allows(F.when(F.col("b").isNotNull(), F.col("r")), F.col("p"), "bot").alias("bot"), texts.robots_allows(F.when(F.col("b").isNotNull(), F.col("r")), F.col("p"), "other").alias("other")).collect()
    assert [(r.bot, r.other) for r in rows] == [(True, False), (False, False), (True, False), (True, True)]
    assert column(spark, [body], texts.sitemap_directives) == [["https://ex.org/s.xml"]]
    assert column(spark, ["<urlset><url><loc> https://a/?x=1&amp;y=2 </loc></url><url><loc>https://b</loc></url></urlset>", None], texts.sitemap_urls) == [["https://a/?x=1&y=2", "https://b"], []]


def test_vectors(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<float>, b array<float>")
    got = [r.c for r in df.select("i", vectors.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.normalised, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]


PAGE = """<html><head><title> A  page </title><script>var x = "<p>no</p>"</script><link rel="license" href="https://ex.org/mit">
<script type="application/ld+json">{"license": "https://creativecommons.org/licenses/by-sa/4.0/"}</script></head>
<body><nav><a href="/home">Home</a></nav><main><h1>Head</h1><p>First paragraph that is certainly longer than fifty bytes, <b>bold</b> too.<p>Second one, also longer than the fifty bytes that are asked for.
<ul><li>short<li>An item of a list that is longer than fifty bytes, so it is kept <i>whole</i>.</ul><aside><p>An aside that is longer than fifty bytes but is not content.</p></aside></main>
<footer><a href="/l">CC BY-SA 4.0</a></footer><a href="b/../c/#f">c</a><a href="mailto:x@y">m</a></body></html>"""


def test_markup():
    doc = markup.parse(PAGE)
    assert markup.title_of(doc) == "A  page"
    assert markup.paragraphs_of(doc) == ["First paragraph that is certainly longer than fifty bytes, bold too.", "Second one, also longer than the fifty bytes that are asked for.", "An item of a list that is longer than fifty bytes, so it is kept whole."]
    assert markup.text_of(doc).startswith("Head First paragraph") and "aside" not in markup.text_of(doc) and "Home" not in markup.text_of(doc)
    assert markup.links_of(doc, "https://ex.org/a/") == [{"href": "https://ex.org/home", "anchor": "Home"}, {"href": "https://ex.org/l", "anchor": "CC BY-SA 4.0"}, {"href": "https://ex.org/a/c", "anchor": "c"}]
    assert markup.license_of(doc) == {"url": "https://creativecommons.org/licenses/by-sa/4.0/", "type": "CC BY-SA"}
    assert markup.license_of(markup.parse("<footer><p><a href='/x'>Licence: CC0</a></p></footer>"))["type"] == "CC0"
    assert markup.license_of(markup.parse("<p><a href='/x'>CC0</a></p>")) is None
    assert markup.license_of(markup.parse("<a rel='license' href='https://www.gnu.org/licenses/gpl-2.0.html'>")) is None
    assert markup.title_of(markup.parse(None)) == "" and markup.paragraphs_of(markup.parse("")) == []
    assert markup.title_of(markup.parse("<title>a <b>c</b></title>")) == "a <b>c</b>"
