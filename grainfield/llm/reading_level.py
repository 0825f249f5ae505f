"""Problem 10: a reading band for each document of English prose, by smoothed unigram language models of the bands."""

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

BANDS = ("basic", "middle", "advanced")
#: Labelled documents the models are fitted on, at most, chosen by hash; labels beyond are not needed for three word lists.
LABELLED = 5_000
#: Least words of a document, and least part of it that must be running English.
LEAST_WORDS, LEAST_SHARE = 50, 0.5
#: Frequent English words that carry no topic.
FUNCTION_WORDS = frozenset(
    """a about after again all also although an and any are as at be because been before between but by can cannot could did do does each every few first for from
    had has have he her him his how i if in into is it its later less like many may more most much must my near never next no nor not note now of off on once one only or other our
    out over same she should since so some such than that the their them then there these they this those through throughout to too under until up us was we were what when where
    which while who whose why will with within without would you your""".split()
)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
#: Marks that running text hardly has, and short lines that are statements, log entries or version notes.
MARKS = re.compile(r"[{}\[\]=$\\_|~^<>#@]|\w\(|::|;\s*$|//")
STATEMENT = re.compile(r"^\s*(?:#include|import |from \w+ import|return |def |class |for \w+ in |export |let |const |if [\w ]+:$|\$ )|^\s*(?:SELECT|INSERT|UPDATE|DELETE)\b.*\b(?:FROM|INTO|SET)\b|^\s*v?\d+(?:\.\d+)+\s|^\s*\[?\d{4}-\d\d-\d\d")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[a-z]+")


def plain(text: str) -> str:
    """A text without tags, entities, accents and invisible characters, in the letters that look the same."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text


def prose_parts(text: str) -> tuple[list[str], int]:
    """(sentences or lines of running text, words of all lines); lines of code, tables, logs and headings' marks are set aside."""
    parts, total, fenced = [], 0, False
    for line in plain(text).split("\n"):
        if "```" in line:  # what stands outside the fence is text
            pieces = line.split("```")
            line = " ".join(pieces[int(fenced) :: 2])
            fenced = fenced ^ (len(pieces) % 2 == 0)
            outside = True
        else:
            outside = not fenced
        tokens = line.split()
        total += len(tokens)
        if not tokens or not outside or 4 * len(MARKS.findall(line)) > len(tokens) or (len(tokens) < 15 and STATEMENT.search(line)):
            continue
        if 2 * sum(1 for t in tokens if t[:1].isdigit() or not t[0].isalnum()) > len(tokens) + 1 or (line.count("\t") > 1 and len(tokens) <= 2 * line.count("\t") + 2):
            continue
        parts += [p for p in SENTENCE.split(line) if p]
    return parts, total


class Levels:
    """Log probabilities of words in each band with add-one smoothing; a word no labelled document has is the unknown word, which has the smoothed mass of one word."""

    def __init__(self, counts: dict[tuple[str, str], int], priors: dict[str, int]):
        words = sorted({w for _, w in counts} | FUNCTION_WORDS)
        self.number = {w: i + 1 for i, w in enumerate(words)}
        table = np.ones((len(words) + 1, len(BANDS)))
        for (band, w), n in counts.items():
            table[self.number[w], BANDS.index(band)] += n
        self.log = np.log(table / table.sum(axis=0))
        self.log = np.concatenate([self.log, [[float(w in FUNCTION_WORDS)] for w in ["", *words]]], axis=1)
        prior = np.array([priors.get(b, 0) + 1.0 for b in BANDS])
        self.prior = np.log(prior / prior.sum())

    def bands(self, texts: list[str | None]) -> list[str | None]:
        """The band of each text that is mainly English prose, else None: the band of highest posterior probability, over all words of its running text."""
        numbers: list[int] = []
        ends, docs, words_of = [], [], []
        totals = np.zeros(len(texts), dtype=np.int64)
        get = self.number.get
        for i, t in enumerate(texts):
            if not t or len(t) < LEAST_WORDS:
                continue
            parts, totals[i] = prose_parts(t)
            for p in parts:
                found = WORD.findall(p.lower())
                if found:
                    numbers += [get(w, 0) for w in found]
                    ends.append(len(numbers))
                    docs.append(i)
                    words_of.append(len(p.split()))
        out: list[str | None] = [None] * len(texts)
        if not ends:
            return out
        d, n, nums = np.array(docs), np.array(words_of), np.array(numbers)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(self.log[nums], starts, axis=0)
        tokens = np.diff(np.concatenate([starts, [len(numbers)]]))
        size = len(texts)
        words, function, letters = np.bincount(d, n, size), np.bincount(d, sums[:, 3], size), np.bincount(d, tokens, size)
        posterior = np.stack([np.bincount(d, sums[:, k], size) for k in range(3)], axis=1) + self.prior
        good = (words >= LEAST_WORDS) & (words >= LEAST_SHARE * totals) & (function >= 0.2 * letters)
        for i in np.flatnonzero(good):
            out[i] = BANDS[int(posterior[i].argmax())]
        return out


def agreed_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, band): the band most annotators gave; null, unknown and tied bands are left out."""
    clean = labels.select("doc_id", F.lower(F.trim("band")).alias("band")).filter(F.col("band").isin(*BANDS) & F.col("doc_id").isNotNull())
    votes = clean.groupBy("doc_id").agg(*[F.count(F.when(F.col("band") == b, 1)).alias(b) for b in BANDS])
    most = F.greatest(*[F.col(b) for b in BANDS])
    only = sum(F.when(F.col(b) == most, 1).otherwise(0) for b in BANDS) == 1
    return votes.filter(only).select("doc_id", F.coalesce(*[F.when(F.col(b) == most, F.lit(b)) for b in BANDS]).alias("band"))


def fit_levels(docs: DataFrame, labels: DataFrame) -> Levels:
    """Models from at most LABELLED labelled documents; all their word counts per band, as many as these documents have words, reach the driver."""
    agreed = agreed_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    chosen = stored(docs.select("doc_id", "text").join(stored(agreed, "labels"), "doc_id").filter("text IS NOT NULL"), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            for band, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in prose_parts(text)[0]:
                    for w in WORD.findall(p.lower()):
                        counts[band, w] = counts.get((band, w), 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], ["band", "word", "n"])

    words = chosen.select("band", "text").mapInArrow(run, "band string, word string, n long").groupBy("band", "word").agg(F.sum("n").alias("n"))
    priors = {r.band: r["count"] for r in chosen.groupBy("band").count().collect()}
    return Levels({(r.band, r.word): r.n for r in words.toLocalIterator()}, priors)


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, band) of each document that is mainly English running prose of at least 50 words.

    Null, empty, short and other texts have no row. With no labels every band is as likely, and the first is given.
    The models hold the words of the labelled documents and are sent to the tasks; nothing is shuffled. A row that is
    repeated is answered each time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_levels(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1):
                bands = sent.value.bands(b.column(1).to_pylist())
                keep = pa.array([k for k, x in enumerate(bands) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([x for x in bands if x], pa.string())], ["doc_id", "band"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, band string")
