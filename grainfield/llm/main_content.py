"""Problem 7: the main body of each page, by a tree of page, sections and lines with messages passed up and down."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.batches import pieces
from grainfield.session import stored

#: Pages the model is trained on, at most, chosen by hash of the id; every page is then classified.
LABELLED = 3_000
FEATURES = 1 << 15
LONG = 60

#: Pages of a site, as a number and a part of its pages, and sites, as a number and a part of all, from which on a line recurs.
SITE_PAGES, SITE_SHARE, SITES, SITES_SHARE = 5, 0.15, 3, 0.02
#: Words that the web at large has in lines around a text; only the seed labels of the sample know them, the model does not.
CUES = re.compile(
    r"""\b(?:cookies?|privacy|consent|copyright|newsletter|subscribe|sponsored|advertisement)\b|©|\(c\)\s*\d|\b(?:all|some)\ rights\b|^\W*(?:skip\ to|back\ to\ top|menu$|powered\ by|tags?:|share\b(?!-)|by\s\w+(?:\s\w+)?\W*$)|
    ^\W*last\ (?:edited|updated|modified)|^\W*[\d,.]+\s(?:comments?|views|likes)\b|^\W*(?:related|read\ also|see\ also|read\ more|more\ on)\b[^:]*:|[←→]""",
    re.X,
)
STATEMENT = re.compile(r"[{}=;$]|\w\(|\):$|:\s*$|^\s*#include|^select .* from")
DIGITS, CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = re.compile(r"[a-z]+|\d+|[^\sa-z\d]")


def letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def is_prose(line: str) -> bool:
    return len(line) >= LONG and line.rstrip()[-1:] in ".!?:;\"”)…" and line.count(" ") >= 6


def stem(line: str) -> str:
    """A line without bullet, trailing mark and doubled spaces, lower case."""
    s = line.strip()
    if s[:1] in ("•", "·") or (s[:1] == "*" and s[1:2].isspace()):
        s = s[1:].lstrip()
    for mark in ("»", "...", "…"):
        if s.endswith(mark):
            s = s[: -len(mark)]
            break
    return " ".join(s.lower().split())


def is_statement(low: str) -> bool:
    """Whether a stem looks like code; most lines have none of its characters and are not searched."""
    return (any(map(low.__contains__, "{}=;$(")) or low.endswith(":") or low.startswith(("#", "select "))) and STATEMENT.search(low) is not None


def line_keys(line: str, label: str) -> tuple[str, str]:
    """The letters of a line, and of its beginning up to a colon, without the name of its site: by these lines that recur are known."""
    low = line.lower()
    low = low.replace(label, "") if label else low
    head, colon, _ = low.partition(":")
    return letters(low), f"{letters(head)}:" if colon and len(head) < LONG else ""


def seed_labels(lines: list[str], title: str, label: str, on_site: set[str], on_sites: set[str]) -> tuple[list[int], list[str]]:
    """(labels, heads of lists): 1 for the main body, 0 for what surrounds it, -1 where the page's structure does not tell; lines are not blank.

    A page whose title does not stand in its text has no body. Before the title all is furniture. After it a line is furniture if it
    recurs over its site, or over several sites and leads to no text, or begins with words and a colon that do, or has a cue of the web at large, or
    stands in a list of short lines that a recurring line heads. Running text, items and code are main body, and so is a line of its own that leads to text.
    """
    key = letters(title)
    at = next((i for i, x in enumerate(lines) if key and letters(x) == key), None)
    if at is None:
        return [0] * len(lines), []
    out, listed, heads = [0] * len(lines), False, []
    out[at] = 1
    inside = [bool(x.lstrip(" *•-·0123456789.)")[:1].islower() or is_statement(stem(x))) for x in lines]
    prose = [is_prose(x.strip()) for x in lines]
    keys = [line_keys(x, label) for x in lines]
    cues = [CUES.search(stem(x)) is not None for x in lines]
    near, far = [k in on_site for k, _ in keys], [k in on_sites for k, _ in keys]
    for i in range(at + 1, len(lines)):
        leads = any(prose[j] or inside[j] or lines[j].strip().endswith((".", "!", "?")) for j in range(i + 1, min(i + 3, len(lines))))
        if cues[i] or (keys[i][1] in on_sites and not inside[i] and len(lines[i]) < 160):
            listed = False
        elif prose[i]:
            out[i], listed = int(not near[i] and not far[i]), False
        elif near[i] or far[i]:  # a heading that recurs, or the head of a list
            out[i] = (-1 if near[i] else 1) if leads else 0
            listed = not leads and i + 1 < len(lines) and not (near[i + 1] or far[i + 1] or cues[i + 1])
            if listed:
                heads.append(stem(lines[i]))
        elif inside[i] or not listed:
            out[i], listed = (1 if inside[i] or leads or lines[i].strip().endswith((".", "!", "?")) else -1), False
    return out, heads


class Featurizer:
    """Hashed features of each line of a page; those that depend on the line alone are kept."""

    def __init__(self, heads: frozenset[str] = frozenset()):
        #: lines that head a list of links, as the labelled pages have them
        self.heads = heads
        self.own: dict[str, tuple[list[int], str, bool]] = {}
        self.names: dict[str, int] = {}

    def code(self, *names: str) -> list[int]:
        known = self.names
        try:
            return [known[n] for n in names]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for n in names:
                known[n] = crc32(n.encode()) % FEATURES
            return [known[n] for n in names]

    def line(self, raw: str) -> tuple[list[int], str, bool]:
        got = self.own.get(raw)
        if got:
            return got
        s = raw.strip()
        length = len(s)
        low = stem(raw)
        head = TOKEN.findall(low[:60])
        tail = TOKEN.findall(low[-30:])
        first = s.lstrip(" *•·-")[:1]
        shape = "a" if first.islower() else "A" if first.isupper() else "9" if first.isdigit() else first
        size = min(12, int(log2(length + 1) * 1.5))
        names = [f"w{w}" for w in head[:5]] + [f"t{w}" for w in tail[-3:]] + [f"b{a}_{b}" for a, b in zip(head[:3], head[1:4], strict=False)]
        names += [f"s{size}", f"f{shape}", f"e{low[-1:] if not low[-1:].isalnum() else 'x'}", f"fs{shape}{size}", f"c{min(low.count(' '), 8)}"]
        names += [f"m{x}" for x in ("|", "›", ">", "←", "→", "©", "{", "(", "=", "$", ";", "_") if x in low]
        words = low.count(" ") + 1
        names += [f"d{min(sum(map(low.count, DIGITS)), 5)}", f"v{min(length // words, 12)}", f"q{min(sum(map(s.count, CAPITALS)) * 8 // words, 8)}", f"j{min(low.count('. ') + low.count('? ') + low.count('! '), 6)}"]
        if is_statement(low):
            names.append("code")
        got = (self.code(*names), " ".join(head[:2]), is_prose(s))
        if len(raw) < 120:
            if len(self.own) > 200_000:
                self.own.clear()
            self.own[raw] = got
        return got

    def page(self, lines: list[str], title: str, site: str) -> tuple[list[list[int]], list[int]]:
        """(features of each line, section of each line). A section is a stretch of long or of short lines, cut at the title."""
        own = [self.line(x) for x in lines]
        key = letters(title)
        short = [i for i, x in enumerate(lines) if key and len(x) < len(title) * 2 + 20]
        at = next((i for i in short if letters(lines[i]) == key), None)
        sections, number, head, run = [], -1, "", 0
        until, nxt = [0] * len(lines), 9
        for i in range(len(lines) - 1, -1, -1):
            until[i] = nxt
            nxt = 0 if own[i][2] else min(nxt + 1, 9)
        feats, listed = [], False
        for i, (codes, words, prose) in enumerate(own):
            if i == 0 or i == at or i - 1 == at or prose != own[i - 1][2]:
                number, head, run = number + 1, words, 0
            run += 1
            sections.append(number)
            where = "n" if at is None else "b" if i < at else "t" if i == at else "a"
            shape = "p" if prose else "s"
            if prose:
                listed = False
            elif len(lines[i]) < LONG and stem(lines[i]) in self.heads:
                listed = True
            lower = lines[i].lstrip(" *•-·0123456789.)")[:1].islower()
            names = (
                f"at{where}", f"ats{where}{shape}", f"r{head}", f"rl{head}{lower}", f"u{min(until[i], 3)}", f"us{min(until[i], 3)}{shape}{where}{lower}", f"p{own[i - 1][1] if i else '^'}", f"n{own[i + 1][1] if i + 1 < len(own) else '$'}",
                f"x{min(len(lines) - 1 - i, 6)}{where}", f"l{listed}{lower}{shape}{where}", f"ul{min(until[i], 2)}{listed}{where}{shape}", f"k{min(run, 4)}{shape}{where}", f"site{bool(site) and site in lines[i].lower()}{shape}",
            )
            feats.append(codes + self.code(*names))
        return feats, sections


def fit_logistic(feats: list[list[int]], labels: np.ndarray, rounds: int = 6, rate: float = 0.15, shrink: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression over hashed features, by mini-batches with AdaGrad; the last weight is the bias."""
    sizes = np.array([len(f) for f in feats])
    flat = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    w, g2 = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-3)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        order = rng.permutation(len(feats))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            n = sizes[rows]
            idx = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cols, row = flat[idx], np.repeat(np.arange(len(rows)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[cols], len(rows)) + w[-1], -30, 30)))
            err = p - labels[rows]
            grad = np.bincount(cols, err[row], FEATURES + 1) / len(rows)
            grad[-1] = err.mean()
            grad += shrink * w
            g2 += grad * grad
            w -= rate * grad / np.sqrt(g2)
    return w


@dataclass
class TreeModel:
    """Line evidence and parent-child potentials: page -> section -> line, each 0 (furniture) or 1 (main body)."""

    weights: np.ndarray
    root: np.ndarray
    section: np.ndarray
    line: np.ndarray
    prior: np.ndarray
    heads: frozenset[str] = frozenset()

    @classmethod
    def train(cls, pages: list[tuple[list[str], str, str, list[int]]], heads: frozenset[str] = frozenset()) -> TreeModel:
        """From labelled pages (lines, title, site, labels); a section's state is that of most of its lines, a page's that of any line.

        Lines without a label teach nothing, but stand beside those that have one.
        """
        feats, labels, f = [], [], Featurizer(heads)
        root, section, line = np.ones(2), np.ones((2, 2)), np.ones((2, 2))
        for lines, title, site, y in pages:
            x, s = f.page(lines, title, site)
            feats += [a for a, b in zip(x, y, strict=True) if b >= 0]
            labels += [b for b in y if b >= 0]
            r = int(1 in y)
            root[r] += 1
            for k in range(s[-1] + 1 if s else 0):
                own = [b for a, b in zip(s, y, strict=True) if a == k and b >= 0]
                if not own:
                    continue
                z = int(2 * sum(own) > len(own))
                section[r, z] += 1
                for b in own:
                    line[z, b] += 1
        y = np.array(labels, dtype=float)
        prior = np.array([(1 - y).sum() + 1, y.sum() + 1])
        weights = fit_logistic(feats, y) if feats else np.zeros(FEATURES + 1)
        return cls(weights, *(np.log(m / m.sum(axis=-1, keepdims=True)) for m in (root, section, line, prior)), heads)

    def marginals(self, pages: list[tuple[list[str], str, str]], featurizer: Featurizer) -> list[np.ndarray]:
        """Probability of being main body of each line of each page, by one upward and one downward pass over all trees at once."""
        counts, sections, feats = [], [], []
        base = 0
        bases = []
        for lines, title, site in pages:
            x, s = featurizer.page(lines, title, site)
            counts.append(len(lines))
            feats += x
            sections += [base + k for k in s]
            bases += [len(counts) - 1] * (s[-1] + 1 if s else 0)
            base += s[-1] + 1 if s else 0
        if not feats:
            return [np.empty(0) for _ in pages]
        sizes = np.array([len(f) for f in feats])
        flat = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=int(sizes.sum()))
        score = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) + self.weights[-1]
        evidence = np.stack([-np.logaddexp(0, score), -np.logaddexp(0, -score)], axis=1) - self.prior
        sec, page = np.array(sections), np.array(bases)
        up_line = np.logaddexp(self.line[:, 0] + evidence[:, :1], self.line[:, 1] + evidence[:, 1:])  # line -> section
        at_section = np.stack([np.bincount(sec, up_line[:, z], base) for z in (0, 1)], axis=1)
        up_section = np.logaddexp(self.section[:, 0] + at_section[:, :1], self.section[:, 1] + at_section[:, 1:])  # section -> page
        at_page = np.stack([np.bincount(page, up_section[:, r], len(pages)) for r in (0, 1)], axis=1) + self.root
        down = at_page[page] - up_section  # page -> section, without the section's own word
        section = np.stack([np.logaddexp(down[:, 0] + self.section[0, z], down[:, 1] + self.section[1, z]) for z in (0, 1)], axis=1) + at_section
        down = section[sec] - up_line
        belief = np.stack([np.logaddexp(down[:, 0] + self.line[0, y], down[:, 1] + self.line[1, y]) for y in (0, 1)], axis=1) + evidence
        main = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        return np.split(main, np.cumsum(counts)[:-1])


def site_label(site: str | None) -> str:
    """The part of a host that names the site."""
    parts = (site or "").split(".")
    return parts[-2] if len(parts) > 1 else parts[0]


def split_page(text: str | None) -> tuple[list[int], list[str]]:
    """(numbers from 1, lines) of the lines of a text that are not blank."""
    lines = (text or "").split("\n")
    kept = [i for i, x in enumerate(lines) if x.strip()]
    return [i + 1 for i in kept], [lines[i] for i in kept]


def _keyed(pages: DataFrame) -> DataFrame:
    """(site, key): each of the `line_keys` of a page once."""
    parts = F.split("site", r"\.")
    label = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    low = F.lower(F.coalesce("text", F.lit("")))
    bare = lambda x: F.regexp_replace(x, r"[^\p{L}]+", "")
    lines = F.split(F.when(label != "", F.replace(low, label, F.lit(""))).otherwise(low), "\n", -1)
    heads = F.transform(lines, lambda x: F.regexp_extract(x, f"^([^:]{{0,{LONG - 1}}}):", 1))
    keys = F.concat(F.transform(lines, bare), F.transform(F.filter(heads, lambda x: x != ""), lambda x: F.concat(bare(x), F.lit(":"))))
    return pages.select("site", F.explode(F.array_distinct(F.filter(keys, lambda x: ~x.isin("", ":")))).alias("key"))


def recurring_keys(pages: DataFrame, sample: DataFrame) -> tuple[dict[str, set[str]], set[str]]:
    """(keys that recur on each site, keys that recur on several sites), of those that stand in the sample, counted over all pages.

    Pages of (site, text). Hashes of keys are counted in the cluster by site; only keys of the sample, which is bounded, reach the driver.
    """
    own = _keyed(sample).distinct().withColumn("h", F.xxhash64("key"))
    wanted = stored(own.select("h").distinct(), "keys")
    counts = stored(_keyed(pages).select("site", F.xxhash64("key").alias("h")).join(wanted, "h", "left_semi").groupBy("site", "h").agg(F.count("*").alias("n")), "counts")
    sizes = stored(pages.groupBy("site").agg(F.count("*").alias("pages")), "sizes")
    least = max(SITES, SITES_SHARE * sizes.count())
    far = counts.groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= least).select("h")
    near = counts.join(sizes, "site").filter(F.col("n") >= F.greatest(F.lit(float(SITE_PAGES)), SITE_SHARE * F.col("pages") - 1e-9)).select("site", "h")
    on_site: dict[str, set[str]] = {}
    for r in own.join(near, ["site", "h"]).select("site", "key").toLocalIterator():
        on_site.setdefault(r.site, set()).add(r.key)
    return on_site, {r.key for r in own.join(far, "h", "left_semi").select("key").distinct().toLocalIterator()}


def fit_tree(pages: DataFrame) -> TreeModel:
    """Train on a sample of at most LABELLED pages (id, site, title, text), labelled by `seed_labels`; what recurs is counted over all pages."""
    pages = pages.withColumn("site", F.coalesce("site", F.lit("")))
    total = pages.count()
    rate = min(1.0, 0.95 * LABELLED / max(total, 1))
    sample = stored(pages.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("id", "site", "title", "text").limit(LABELLED), "sample")
    on_site, on_sites = recurring_keys(pages, sample)
    labelled, heads = [], Counter()
    for r in sample.orderBy("id").toLocalIterator():
        lines, label = split_page(r.text)[1], site_label(r.site)
        if lines:
            y, found = seed_labels(lines, r.title or "", label, on_site.get(r.site, set()), on_sites)
            heads.update(found)
            labelled.append((lines, r.title or "", label, y))
    return TreeModel.train(labelled, frozenset(k for k, n in heads.items() if n >= SITES))


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines outside the main body; `pages` has (id, site, title, text), one row a page.

    Nothing is shuffled: the model, of fixed size, is sent to the tasks, and each page is a tree of its own. Null and
    empty texts have no lines; a page without a body loses all its lines. A page that is repeated is answered each time.
    """
    sent = pages.sparkSession.sparkContext.broadcast(fit_tree(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(sent.value.heads)
        for whole in batches:
            for b in pieces(whole, 3):
                ids = b.column(0).to_pylist()
                split = [split_page(t) for t in b.column(3).to_pylist()]
                rows = [(s[1], t or "", site_label(x)) for s, t, x in zip(split, b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
                got = sent.value.marginals(rows, featurizer)
                out_id, out_no = [], []
                for i, (numbers, _), p in zip(ids, split, got, strict=True):
                    gone = [n for n, x in zip(numbers, p.tolist(), strict=True) if x < 0.5]
                    out_id += [i] * len(gone)
                    out_no += gone
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_no, pa.int32())], ["id", "line_no"])

    return pages.select(F.col("id").cast("long").alias("id"), "site", "title", "text").mapInArrow(run, "id long, line_no int")


def main_text(pages: DataFrame) -> DataFrame:
    """(id, body): the text of each page without the lines outside its main body; null where the text is null."""
    gone = furniture_lines(pages).groupBy("id").agg(F.collect_set(F.col("line_no") - 1).alias("_gone"))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    return pages.select("id", "text").join(gone, "id", "left").select("id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("body"))
