"""Problem 8: token ids of every text by a public byte-level BPE, by replaying its merges over the words of the corpus."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.batches import pieces

#: The pattern by which this family of tokenizers splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts that are all ASCII.
ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """Ids of words by the merges of a vocabulary file; words seen before keep their ids."""

    def __init__(self, file: bytes, most_words: int = 1_000_000):
        import regex

        spec = json.loads(file)["model"]
        vocab, letters = spec["vocab"], byte_letters()
        self.single = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.single[byte] = vocab[letter]
        #: merged pair -> its rank; rank -> the pair and the id made of it
        self.rank: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = []
        for r, m in enumerate(spec["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = vocab[a], vocab[b]
            self.rank.setdefault(x << 20 | y, r)
            self.made.append((x, y, vocab[a + b]))
        self.words = regex.compile(PATTERN)
        self.most = most_words
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        return ASCII.findall(text) if text.isascii() else self.words.findall(text)

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number for each word).

        All words lie in one array of symbols with links to their neighbours. An index from symbol pair to
        positions is made once; the merges then run in rank order, each over the positions of its pair, and
        add to the index only the pairs with the neighbours of what they made.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.single[flat]
        n = len(symbols)
        last = np.cumsum(sizes) - 1
        after = np.arange(1, n + 1)
        after[last[sizes > 0]] = -1
        before = np.arange(-1, n - 1)
        before[(last - sizes + 1)[sizes > 0]] = -1
        index: dict[int, list[int]] = {}
        inside = np.flatnonzero(after >= 0)
        if len(inside):
            pairs = symbols[inside] << 20 | symbols[inside + 1]
            order = np.argsort(pairs, kind="stable")
            keys, first = np.unique(pairs[order], return_index=True)
            for key, at in zip(keys.tolist(), np.split(inside[order], first[1:]), strict=True):
                if key in self.rank:
                    index[key] = at.tolist()
        s, nxt, prv = symbols.tolist(), after.tolist(), before.tolist()
        heap = [self.rank[k] for k in index]
        heapq.heapify(heap)
        rank, made = self.rank, self.made
        while heap:
            x, y, z = made[heapq.heappop(heap)]
            for p in sorted(index.pop(x << 20 | y)):
                q = nxt[p]
                if s[p] != x or q < 0 or s[q] != y:
                    continue
                s[p], s[q] = z, -1
                r, o = nxt[q], prv[p]
                nxt[p] = r
                if r >= 0:
                    prv[r] = p
                for key, at in ((s[o] << 20 | z, o) if o >= 0 else (-1, 0), (z << 20 | s[r], p) if r >= 0 else (-1, 0)):
                    k = rank.get(key)
                    if k is not None:
                        if key in index:
                            index[key].append(at)
                        else:
                            index[key] = [at]
                            heapq.heappush(heap, k)
        out = np.array(s, dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        return out[out >= 0].astype(np.int32), np.bincount(word[out >= 0], minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number for each text)."""
        if len(self.number) > self.most:
            self.clear()
        number, counts, places = self.number, np.zeros(len(texts), dtype=np.int64), []
        known = len(number)
        for i, t in enumerate(texts):
            if t:
                words = self.split(t)
                counts[i] = len(words)
                try:
                    places += map(number.__getitem__, words)
                except KeyError:
                    del places[int(counts[:i].sum()) :]
                    for w in words:
                        number.setdefault(w, len(number))
                    places += map(number.__getitem__, words)
        if len(number) > known:
            ids, sizes = self.replay(list(number)[known:])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        w = np.array(places, dtype=np.int64)
        size = self.sizes[w]
        total = np.cumsum(size)
        at = np.repeat(self.starts[w] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        return self.ids[at], np.diff(np.concatenate([[0], ends]))


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str, most_bytes: int = 2_000_000) -> DataFrame:
    """(key, ids) of every row by the vocabulary file, without special tokens; their strings are ordinary text.

    Null and empty texts have an empty list. Nothing is shuffled: each task replays the merges once over every
    word new to its part of the corpus, and maps its texts through the words' ids. The vocabulary file, of
    fixed size, is sent to the tasks.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = None
        for batch in batches:
            replay = replay or MergeReplay(sent.value)
            for b in pieces(batch, 1, most_bytes):
                ids, counts = replay.encode(b.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
