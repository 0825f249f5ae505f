"""HTML as Arrow UDFs over the standard library's parser: title, text, paragraphs, links and licence of a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfield import rules

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag ends an open element of these kinds, as HTML leaves the end tag out
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SPACES = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        """This element and all below it in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, as it stands."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close("p", {"button", "table", "#root"})
        for t in ENDS.get(tag, ()):
            self._close(t, {"ul", "ol", "dl", "table", "select", "#root"})
        node = Node(tag, {k.lower(): v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close(tag, {"#root"})

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, tag, barriers):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in barriers:
                return


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def content_root(doc: Node) -> Node:
    """The first article or main element, else the whole document."""
    return next((n for n in doc.walk() if n.tag in ("article", "main")), doc)


def title_of(doc: Node) -> str:
    return next((t for n in doc.walk() if n.tag == "title" and (t := n.text().strip())), "")


def text_of(doc: Node) -> str:
    """Text of the content root without skipped elements, white space collapsed."""
    out, todo = [], [content_root(doc)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                out.append(n.strip())
        elif n.tag not in rules.SKIPPED_TAGS:
            todo += reversed(n.children)
    return SPACES.sub(" ", " ".join(out)).strip()


def paragraphs_of(doc: Node, least_bytes: int = 50, most: int = 30) -> list[str]:
    """Text of the outermost block elements of the content root, of at least so many bytes, the first so many."""
    out, todo = [], [content_root(doc)]
    while todo and len(out) < most:
        n = todo.pop()
        if isinstance(n, str) or n.tag in rules.SKIPPED_TAGS:
            continue
        if n.tag in rules.BLOCK_TAGS:
            t = n.text().strip()
            if len(t.encode()) >= least_bytes:
                out.append(t)
            continue
        todo += reversed(n.children)
    return out


def links_of(doc: Node, base: str) -> list[dict[str, str]]:
    """(href, anchor) of all links to http(s), made absolute, without fragment and trailing slash."""
    out = []
    for n in doc.walk():
        if n.tag == "a" and n.attrs.get("href"):
            try:
                u = urlsplit(urljoin(base, n.attrs["href"].strip()))
            except ValueError:
                continue
            if u.scheme in ("http", "https"):
                out.append({"href": u._replace(fragment="", path=u.path.rstrip("/")).geturl(), "anchor": n.text().strip()})
    return out


def _by_url(url: str) -> str | None:
    low = url.lower()
    return next((kind for sub, kind in rules.LICENSE_URLS + rules.PUBLIC_DOMAIN_URLS if sub in low), None)


def license_of(doc: Node) -> dict[str, str] | None:
    """(url, type) of the first accepted licence: link rel, JSON-LD, anchor rel, meta, links in footers."""
    nodes = list(doc.walk())
    rel = lambda n: "license" in n.attrs.get("rel", "").lower().split()
    found = [n.attrs.get("href", "") for n in nodes if n.tag == "link" and rel(n)]
    for n in nodes:
        if n.tag == "script" and "ld+json" in n.attrs.get("type", "").lower():
            found += re.findall(r'"license"\s*:?\s*[^"]*"([^"]*)"', n.text())[:1]
    found += [n.attrs.get("href", "") for n in nodes if n.tag == "a" and rel(n)]
    found += [n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() in ("license", "dc.rights")]
    for url in found:
        if kind := _by_url(url):
            return {"url": url, "type": kind}
    for foot in nodes:
        if foot.tag == "footer":
            for n in foot.walk():
                if n.tag != "a":
                    continue
                if kind := _by_url(n.attrs.get("href", "")):
                    return {"url": n.attrs["href"], "type": kind}
                name = n.text().strip().upper()
                for sub, url, kind in rules.FOOTER_NAMES:
                    if sub in name:
                        return {"url": url, "type": kind}
    return None


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor", T.StringType())])
_LICENSE = T.StructType([T.StructField("url", T.StringType()), T.StructField("type", T.StringType())])
_PAGE = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(_LINK)), T.StructField("license", _LICENSE)]
)


@F.pandas_udf(_PAGE)
def html_page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """Everything read from a page in one parse: title, text, paragraphs, links, licence. A null page is an empty one."""
    rows = []
    for h, u in zip(html, url, strict=True):
        doc = parse(h)
        rows.append((title_of(doc), text_of(doc), paragraphs_of(doc), links_of(doc, u or ""), license_of(doc)))
    return pd.DataFrame(rows, columns=["title", "text", "paragraphs", "links", "license"])
