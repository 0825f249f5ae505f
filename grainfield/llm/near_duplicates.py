"""Problem 2: pairs of texts whose sets of word runs overlap, by vertical partitioning of the n-gram order.

A corpus is read once, into a table of n-gram sets. The global n-gram order is (fragment, frequency, hash): FRAGMENTS fragments by
hash, whatever the size of the corpus, and within each the rarest first by a table of counters over all texts. A pair whose whole overlap
is t of the union has a fragment in which that is so too (the mediant of the fragments' ratios), so the prefix
of each segment, the position of a shared n-gram and the sizes of both sides bound what a fragment must be asked for. The tasks of a fragment
are cut by n-gram, and an n-gram of many texts into a grid of blocks, so no task grows with the corpus. The
partial overlaps of the candidates are then counted in each fragment and summed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.batches import pieces
from grainfield.session import stored

WORD = re.compile("[a-z0-9]+")
#: Odd multipliers of a 64-bit mixing function.
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]
#: Fragments the n-gram order is cut into.
FRAGMENTS = 12
#: Counters of the frequency order, and counters of one row on their way to the sum; n-grams of one counter are ordered by hash.
CELLS, CHUNK = 1 << 22, 1 << 14
#: Postings of one task, on the average; it decides how many tasks a fragment has and nothing else.
TASK_POSTINGS = 1_000_000
#: Texts of one n-gram that are held against each other in one block of a grid.
HOT = 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(32))


class Grams:
    """Distinct hashed runs of `width` words for each text of a batch; words keep their hash between batches."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.digest, self.whole, self.known = width, xxhash.xxh64_intdigest, xxhash.xxh3_128_digest, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all hashes, number of each text, words of each text, two numbers that tell its words in their order); each text's hashes are distinct and in order."""
        if len(self.known) > 500_000:
            self.known.clear()
        known, digest = self.known, self.digest
        hashes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            words = WORD.findall(t.lower()) if t else []
            counts[i] = len(words)
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = digest(w)
                hashes.append(h)
        w, k = np.array(hashes, dtype=np.uint64), self.width
        ends = np.cumsum(counts)
        told = np.frombuffer(b"".join(self.whole(w[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
        doc = np.repeat(np.arange(len(texts)), counts)
        if len(w) < k:
            return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64), counts, told
        with np.errstate(over="ignore"):
            run = np.zeros(len(w) - k + 1, dtype=np.uint64)
            for j in range(k):
                run = mixed(run * MIX[2] + w[j : len(w) - k + 1 + j] * MIX[3] + np.uint64(j + 1))
        whole = doc[: len(run)] == doc[k - 1 :]
        run, doc = run[whole], doc[: len(run)][whole]
        order = np.lexsort((run, doc))
        run, doc = run[order], doc[order]
        if not len(run):
            return run, np.zeros(len(texts), dtype=np.int64), counts, told
        first = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])])
        return run[first], np.bincount(doc[first], minlength=len(texts)), counts, told


def _sets(width: int):
    """(id, words, h1, h2, n, sizes, grams) of each text: its distinct n-grams as 32-bit numbers by fragment, with the size of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)
        for batch in batches:
            for b in pieces(batch, 1):
                hashes, counts, words, told = grams(b.column(1).to_pylist())
                cell = np.repeat(np.arange(len(counts)), counts) * FRAGMENTS + ((hashes >> np.uint64(32)) % np.uint64(FRAGMENTS)).astype(np.int64)
                raw = (hashes[np.argsort(cell, kind="stable")] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                ends = np.cumsum(counts) * 4
                sizes = np.bincount(cell, minlength=len(counts) * FRAGMENTS).astype("<u4").reshape(-1, FRAGMENTS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(words), pa.array(told[:, 0].copy()), pa.array(told[:, 1].copy()), pa.array(counts), pa.array([x.tobytes() for x in sizes], pa.binary()), pa.array([raw[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())],
                    ["id", "words", "h1", "h2", "n", "sizes", "grams"],
                )

    return run


def gram_sets(texts: DataFrame, width: int) -> DataFrame:
    """The n-gram sets of (id, text), written once; the texts are not read again."""
    return stored(texts.select("id", "text").mapInArrow(_sets(width), "id long, words long, h1 long, h2 long, n long, sizes binary, grams binary"), "sets")


def _unpacked(sizes: list[bytes], grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment sizes, text by fragment, and all n-grams in a row)."""
    return np.frombuffer(b"".join(sizes), dtype="<u4").reshape(-1, FRAGMENTS).astype(np.int64), np.frombuffer(b"".join(grams), dtype="<u4")


def _cells(gram: np.ndarray, fragment: np.ndarray) -> np.ndarray:
    return ((gram >> np.uint32(10)).astype(np.int64) + fragment * (CELLS // FRAGMENTS)) % CELLS


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """Of each of CELLS counters over all texts' n-grams a class of eighth octaves: 0 where one text alone was counted, 255 where none.

    An n-gram's counter is at least the number of its texts, so a frequent one is never taken for a rare one. Counters are summed
    in the cluster; classes of fixed size reach the driver.
    """
    codec = "zstd"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            sizes, gram = _unpacked(b.column(0).to_pylist(), b.column(1).to_pylist())
            total += np.bincount(_cells(gram, np.repeat(np.tile(np.arange(FRAGMENTS), len(sizes)), sizes.ravel())), minlength=CELLS)
        rows = [(k, pa.compress(total[k * CHUNK : k * CHUNK + CHUNK].tobytes(), codec, asbytes=True)) for k in range(CELLS // CHUNK) if total[k * CHUNK : k * CHUNK + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, dtype=np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(x, CHUNK * 8, codec, asbytes=True), dtype=np.int64)
        octave = np.where(total > 0, np.minimum(np.floor(8 * np.log2(np.maximum(total, 1))), 254), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([octave.tobytes()], pa.binary())], ["chunk", "classes"])

    got = sets.select("sizes", "grams").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, classes binary")
    classes = np.full(CELLS, 255, dtype=np.uint8)
    for r in got.toLocalIterator():
        classes[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.classes, dtype=np.uint8)
    return classes


def _required(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9).astype(np.int64)


def _postings(sent: Broadcast, t: float, tasks: int, hot: int = HOT):
    """Rows of one batch and one task: the prefix of each segment that falls to the task, and what is known of its segments.

    A posting has the n-gram, its place in the segment (rarest first) and its side in a grid; a segment its text, sizes and 128
    parity bits. An n-gram of more than 2 * `hot` texts is cut into r blocks by text: a text of block i goes to the cells of i and every j, so
    any two texts meet in one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        for batch in batches:
            for b in pieces(batch, 3):
                ids, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                sizes, gram = _unpacked(b.column(2).to_pylist(), b.column(3).to_pylist())
                if not len(gram):
                    continue
                size = sizes.ravel()
                seg = np.repeat(np.arange(len(size)), size)
                cls = classes[_cells(gram, seg % FRAGMENTS)]
                order = np.argsort((seg.astype(np.uint64) << np.uint64(40)) | (cls.astype(np.uint64) << np.uint64(32)) | gram, kind="stable")
                gram, cls = gram[order], cls[order]
                starts = np.cumsum(size) - size
                place = np.arange(len(gram)) - starts[seg]
                bit = np.uint64(1) << ((gram >> np.uint32(4)) & np.uint32(63)).astype(np.uint64)
                marks = np.zeros((2, len(size)), dtype=np.uint64)
                full = np.flatnonzero(size)
                for m in (0, 1):
                    marks[m, full] = np.bitwise_xor.reduceat(np.where(((gram >> np.uint32(3)) & np.uint32(1)) == m, bit, np.uint64(0)), starts[full])
                kept = np.flatnonzero((place < (size - np.ceil(size * t - 1e-9).astype(np.int64) + 1)[seg]) & (cls > 0))
                key = mixed(gram[kept].astype(np.uint64) * np.uint64(FRAGMENTS) + (seg[kept] % FRAGMENTS).astype(np.uint64))
                blocks = np.exp2((cls[kept].astype(float) + 1) / 8) / hot
                blocks = np.where(blocks > 2, np.ceil(blocks), 1).astype(np.int64)
                own = (mixed(ids.astype(np.uint64) * MIX[2])[seg[kept] // FRAGMENTS] % blocks.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(kept)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine, kept, key = own[again], kept[again], key[again]
                side = np.where(mine == other, 2, mine > other).astype(np.int32)
                grid = blocks[again] > 1
                key[grid] = mixed(key[grid] * MIX[3] + np.minimum(mine, other)[grid].astype(np.uint64) * MIX[1] + np.maximum(mine, other)[grid].astype(np.uint64))
                per = tasks // FRAGMENTS
                task = (seg[kept] % FRAGMENTS) * per + ((key >> np.uint64(32)) % np.uint64(per)).astype(np.int64)
                by = np.argsort(task, kind="stable")
                cuts = np.flatnonzero(np.diff(task[by], prepend=-1))
                out = []
                for rows in np.split(by, cuts[1:]):
                    if not len(rows):
                        continue
                    segs, no = np.unique(seg[kept[rows]], return_inverse=True)
                    out.append((task[rows[0]], (key[rows] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), no, place[kept[rows]], side[rows], ids[segs // FRAGMENTS], size[segs], n[segs // FRAGMENTS], marks[0, segs].view(np.int64), marks[1, segs].view(np.int64)))
                kinds = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array([int(o[0]) for o in out], pa.int32())] + [pa.array([o[k + 1] for o in out], pa.list_(kind)) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["task", "key", "seg", "place", "side", "id", "size", "n", "m1", "m2"])

    return run


POSTINGS = "task int, key array<int>, seg array<int>, place array<int>, side array<int>, id array<long>, size array<int>, n array<int>, m1 array<long>, m2 array<long>"


def _met(t: float, room: int = 3_000_000):
    """Pairs of texts of which a segment can be similar: they share an n-gram of both prefixes, and sizes, places and parity bits leave room for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            c = {x: b.column(x) for x in ("key", "seg", "place", "side", "id", "size", "n", "m1", "m2")}
            flat = {x: v.flatten().to_numpy(zero_copy_only=False) for x, v in c.items()}
            many = np.diff(c["id"].offsets.to_numpy())
            first = np.repeat(np.cumsum(many) - many, np.diff(c["key"].offsets.to_numpy()))
            flat["seg"] = flat["seg"] + first + base
            base += len(flat["id"])
            parts.append(flat)
        if not parts:
            return
        key, seg, place, side, ids, size, n, m1, m2 = (np.concatenate([p[x] for p in parts]) for x in ("key", "seg", "place", "side", "id", "size", "n", "m1", "m2"))
        parts.clear()
        size, n, m1, m2 = size.astype(np.int64), n.astype(np.int64), m1.view(np.uint64), m2.view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, seg, place, side = key[order], seg[order].astype(np.int64), place[order].astype(np.int64), side[order]
        later = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
        total, begin = np.cumsum(later), 0
        while begin < len(key):
            end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + room, side="right")), begin + 1)
            k = later[begin:end]
            left = np.repeat(np.arange(begin, end), k)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
            begin = end
            x, y = seg[left], seg[right]
            sx, sy = size[x], size[y]
            need = _required(sx, sy, t)
            room_left = np.minimum(sx - place[left], sy - place[right])  # with this n-gram as the first they share
            ok = (room_left >= need) & ((side[left] == 2) | (side[left] != side[right]))
            x, y, sx, sy, need = x[ok], y[ok], sx[ok], sy[ok], need[ok]
            differ = np.bitwise_count(m1[x] ^ m1[y]).astype(np.int64) + np.bitwise_count(m2[x] ^ m2[y])
            ok = (differ <= sx + sy - 2 * need) & (np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9) & (np.minimum(sx, sy) >= t * np.maximum(sx, sy) - 1e-9)
            a, b = ids[x[ok]], ids[y[ok]]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pair = pair[:, pair[0] != pair[1]]
            if pair.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def grouped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    return grouped


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, partial): the overlap of each pair in each fragment."""
    for batch in batches:
        for b in pieces(batch, 4):
            sides = [_unpacked(b.column(k).to_pylist(), b.column(k + 1).to_pylist()) for k in (3, 6)]
            marks = [np.sort((np.repeat(np.arange(s.size, dtype=np.uint64), s.ravel()) << np.uint64(32)) | g) for s, g in sides]
            both = np.sort(np.concatenate(marks))
            shared = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            counts = np.bincount(shared.astype(np.int64), minlength=b.num_rows * FRAGMENTS)
            partial = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * FRAGMENTS), pa.array(counts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(5), partial], ["a", "b", "n_a", "n_b", "partial"])


def copy_classes(sets: DataFrame) -> DataFrame:
    """(id, rep) for texts of the same words in the same order that occur more than once; rep is the least id."""
    signed = sets.select("id", "h1", "h2", "words").filter("words > 0")
    group = signed.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("words").alias("_w")).agg(F.min("id").alias("rep"), F.count("*").alias("k")).filter("k > 1").drop("k")
    group = stored(group, "copies")
    return stored(signed.join(group, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("words") == F.col("_w"))).select("id", "rep"), "classes")


def candidate_pairs(sets: DataFrame, t: float, tasks: int | None = None, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, of which some fragment can be similar; no pair of similarity >= t is missing. The number of tasks changes nothing else."""
    grams = sets.agg(F.sum("n")).first()[0] or 0
    per = max(1, round(grams * (1 - t) / FRAGMENTS / TASK_POSTINGS)) if tasks is None else max(1, tasks // FRAGMENTS)
    sent = sets.sparkSession.sparkContext.broadcast(frequency_classes(sets))
    postings = sets.select("id", "n", "sizes", "grams").mapInArrow(_postings(sent, t, per * FRAGMENTS, hot), POSTINGS)
    return postings.groupBy("task").applyInArrow(_met(t), "a long, b long").distinct()


def similar_representatives(sets: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(a, b, overlap, n_a, n_b) of all pairs of different texts of Jaccard similarity >= t: the partial overlaps of the candidates, summed.

    N-grams are told apart by 32 bits within a fragment.
    """
    reps = sets.join(classes.filter("id <> rep").select("id"), "id", "left_anti").filter("n > 0").select("id", "n", "sizes", "grams")
    pairs = stored(candidate_pairs(reps, t), "pairs")
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sizes").alias("s_a"), F.col("grams").alias("g_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sizes").alias("s_b"), F.col("grams").alias("g_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "s_a", "g_a", "n_b", "s_b", "g_b")
    counted = both.mapInArrow(_partial_overlaps, "a long, b long, n_a long, n_b long, partial array<long>")
    summed = counted.select("a", "b", "n_a", "n_b", F.aggregate("partial", F.lit(0).cast("long"), lambda s, x: s + x).alias("overlap"))
    good = summed.filter(F.col("overlap") >= t * (F.col("n_a") + F.col("n_b") - F.col("overlap")) - 1e-9)
    return good.groupBy("a", "b").agg(F.max("overlap").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def near_duplicate_classes(docs: DataFrame, key: str, text: str, width: int = 5, t: float = 0.8) -> DataFrame:
    """(id, class_id, n_links): each text with the least id of its exact copies and the number of other classes it is similar to.

    Null texts and texts without words are classes of their own without links; so are rows of null id.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sets = gram_sets(rows.filter("id IS NOT NULL"), width)
    classes = copy_classes(sets)
    pairs = stored(similar_representatives(sets, classes, t), "links")
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    own = rows.select("id").join(classes.distinct(), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return own.join(links, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicate_pairs(docs: DataFrame, key: str, text: str, width: int = 5, t: float = 0.8) -> DataFrame:
    """(id_a, id_b) of all pairs of similarity >= t, exact copies included; texts of fewer than `width` words have none.

    A row that is repeated counts once; rows of null id take no part. Copies are joined once and their pairs written out at the end, as the form of the result asks.
    """
    sets = gram_sets(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL"), width)
    classes = copy_classes(sets)
    pairs = similar_representatives(sets, classes, t).select("a", "b")
    classes = classes.distinct()
    a = pairs.join(classes.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").select("b", F.coalesce("x", "a").alias("x"))
    ab = a.join(classes.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
    whole = classes.join(sets.filter("n > 0").select("id"), "id", "left_semi")
    within = whole.select("rep", F.col("id").alias("x")).join(whole.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    return ab.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
