"""Problem 9: documents that contain held-out items in whole or in part, by a broadcast hash set of the items' n-grams."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.batches import pieces
from grainfield.session import stored

TAG = re.compile(r"</?[A-Za-z!][^<>\n]{0,200}>")
WORD = re.compile(r"[a-z0-9]+")
#: Cyrillic and Greek letters, lower case, that look like a Latin letter.
LOOK_ALIKE = str.maketrans(
    "авекмнорстухіјѕһԁԛԝьӏ" + "αβεζηικμνορτυχγωϲ",
    "abekmhopctyxijshdqwbl" + "abezhikmvoptuxywc",
)
KEEP = bytes(range(48, 58)) + bytes(range(97, 123))
DROP = bytes(b for b in range(256) if b not in KEEP and not 65 <= b <= 90)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words in a row that count as a run; part of an item's words that must be found.
RUN, PART = 5, 0.5
#: Letters between two runs of one passage, at most, as a part of the item's letters and at least so many.
GAP_PART, GAP_LEAST = 1.0, 120


def folded(text: str) -> str:
    """A text without tags, entities, accents and invisible characters, with look-alike letters as Latin ones."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(LOOK_ALIKE)
    return text


def letters(text: str) -> bytes:
    """Only the letters a-z and digits of a text, lower case: words broken or joined make no difference."""
    return folded(text).encode("ascii", "ignore").translate(LOWER, DROP)


class Rolling:
    """Hashes of any stretch of a string from one running sum: sum of code(c) * B^k, modulo 2^64, times B^-start."""

    CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def _powers(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << int(np.ceil(np.log2(n)))
            with np.errstate(over="ignore"):
                for name, base in (("up", cls.BASE), ("down", cls.INVERSE)):
                    x = np.full(size, base, dtype=np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x))

    def __init__(self, data: np.ndarray):
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.CODES[data] * self.up[: len(data)])])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.down[start]


class Items:
    """The items' letters, word ends, and the hash set of their runs of RUN words.

    A run is looked up by its first letters, as many as the widest of WIDTHS that it fills, and then checked whole.
    """

    WIDTHS = (40, 30, 22, 16, 10, 5)

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.edges, self.letters = [], [], []
        parts = {w: [] for w in self.WIDTHS}
        for item, text in rows:
            words = WORD.findall(folded(text or "").lower())
            if item is None or len(words) < RUN:
                continue
            data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            roll, start, size = Rolling(data), edges[:-RUN], edges[RUN:] - edges[:-RUN]
            whole = roll.of(start, size)
            width = np.array([next(w for w in self.WIDTHS if w <= n) for n in size])
            for w in self.WIDTHS:
                k = np.flatnonzero(width == w)
                if len(k):
                    parts[w].append(np.stack([roll.of(start[k], w), whole[k], size[k].astype(np.uint64), np.full(len(k), len(self.ids), dtype=np.uint64), k.astype(np.uint64)]))
            self.ids.append(item)
            self.edges.append(edges)
            self.letters.append(len(data))
        self.words = np.array([len(e) - 1 for e in self.edges], dtype=np.int64)
        self.sets = []
        for w, found in parts.items():
            if found:
                head, whole, size, item, word = np.concatenate(found, axis=1)
                o = np.argsort(head, kind="stable")
                bits = max(16, int(np.ceil(np.log2(len(o) * 64))))
                table = np.zeros(1 << bits, dtype=bool)
                table[head >> np.uint64(64 - bits)] = True
                self.sets.append((w, np.uint64(64 - bits), table, head[o], whole[o], size[o].astype(np.int64), item[o].astype(np.int64), word[o].astype(np.int64)))

    def found(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(number of the text, item id, words found) of every item at least PART of whose words stand in a passage of a text."""
        raw = [letters(t) if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        begin = ends - np.array([len(x) for x in raw])
        roll, hits = Rolling(data), []
        for w, shift, table, head, whole, size, item, word in self.sets:
            if len(data) < w:
                continue
            h = roll.of(np.arange(len(data) - w + 1), w)
            at = np.flatnonzero(table[h >> shift])
            lo, hi = np.searchsorted(head, h[at], "left"), np.searchsorted(head, h[at], "right")
            many = hi - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            place = np.repeat(at, many)
            entry = np.repeat(lo, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            doc = np.searchsorted(ends, place, side="right")
            fits = place + size[entry] <= ends[doc]
            place, entry, doc = place[fits], entry[fits], doc[fits]
            same = roll.of(place, size[entry]) == whole[entry]
            hits.append(np.stack([doc[same], item[entry[same]], word[entry[same]], place[same]]))
        doc, item, word, place = np.concatenate(hits, axis=1) if hits else np.empty((4, 0), dtype=np.int64)
        if not len(doc):
            return []
        # items of which enough words can be there at all: a hit covers RUN words, hits side by side one more each
        cells, which, n = np.unique(doc * len(self.ids) + item, return_inverse=True, return_counts=True)
        keep = (n * RUN >= PART * self.words[cells % len(self.ids)])[which]
        runs: dict[tuple[int, int], dict[int, list[int]]] = {}
        for d, k, i, p in zip(doc[keep].tolist(), item[keep].tolist(), word[keep].tolist(), (place - begin[doc])[keep].tolist(), strict=True):
            runs.setdefault((d, k), {}).setdefault(p - int(self.edges[k][i]), []).append(i)
        out = []
        for (d, k), diagonals in runs.items():
            edges, own = self.edges[k], []
            for shift, at in diagonals.items():
                at.sort()
                first = prev = at[0]
                for i in [*at[1:], None]:
                    if i is None or i > prev + 1:
                        own.append((first, prev + RUN, shift + int(edges[first]), shift + int(edges[prev + RUN])))
                        first = i
                    prev = i
            best = self._chain(own, max(GAP_LEAST, GAP_PART * self.letters[k]))
            if best >= PART * self.words[k]:
                out.append((d, self.ids[k], int(best)))
        return out

    @staticmethod
    def _chain(runs: list[tuple[int, int, int, int]], gap: float) -> int:
        """Most words of runs that follow each other in item and text, no two further apart than `gap` letters."""
        runs = sorted(runs, key=lambda r: (r[3], r[1]))
        best = []
        for n, (i, j, a, b) in enumerate(runs):
            most = 0
            for m in range(n - 1, -1, -1):
                pi, pj, pa_, pb = runs[m]
                if a - pb > gap:
                    break
                if pb <= b and pa_ < a and pi < i:
                    over = max(0, pj - i)  # words shared by two overlapping runs count once
                    most = max(most, best[m] - over)
            best.append(most + j - i)
        return max(best)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_items: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_words) of each document that contains at least half of an item's words, in runs of five or more.

    The items are held-out test material, which does not grow with the corpus; more than `most_items` are refused.
    Their hash set is sent to the tasks, and each text is scanned once as a string of letters, whole;
    hits are verified by the words they cover, in the item's order and close together. Nothing is shuffled. Null and
    empty texts and items of fewer than five words have no rows; a document that is repeated is reported each time.
    """
    rows = [(r[0], r[1]) for r in items.select(item_key, item_text).distinct().limit(most_items + 1).collect()]
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items: split them and run once for each part")
    sent = docs.sparkSession.sparkContext.broadcast(Items(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1, most_bytes=1_500_000):
                found = sent.value.found(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())], ["doc_id", "item_id", "n_words"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, n_words int")


def without_contaminated(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without those that `found` (doc_id, ...) names; rows of null key stay. The few found keys are joined, no text moves."""
    return docs.join(stored(found.select(F.col("doc_id").alias("_leaking")).distinct(), "leaking"), F.col(key) == F.col("_leaking"), "left_anti")
