"""Problem 3: text of scanned pages made readable: page furniture out, split words joined, misread words corrected, paragraphs reflowed."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.batches import pieces
from grainfield.session import stored

#: Words of the vocabulary, at most, more are an error; a word must stand in so many texts to be one.
VOCABULARY, LEAST_TEXTS = 400_000, 2
#: Letters from which on a word is not counted.
LONG = 40
#: Counters of the table of neighbouring words, and words that a task counts before it passes them on.
CELLS, COUNTED = 1 << 18, 200_000
#: Letters of a line of a printed page, at most; so many of a scan's lines may be longer, where line ends were lost.
WIDE, WIDE_SHARE = 130, 0.1
#: What a letter or pair of letters is often read as by recognition software.
CONFUSIONS = {
    "o": ("0", "c"), "l": ("1", "i", "|"), "i": ("1", "l", "j"), "s": ("5",), "b": ("6", "h"), "g": ("9", "q"), "q": ("9", "g"), "z": ("2",), "e": ("c", "f"), "c": ("e",), "t": ("f", "l"), "f": ("t",), "h": ("b", "li"),
    "n": ("ri", "u", "ii"), "m": ("rn", "nn"), "u": ("ii", "n"), "d": ("cl",), "w": ("vv",), "li": ("h",), "rn": ("m",), "cl": ("d",), "ri": ("n",), "vv": ("w",), "y": ("v",), "v": ("y",), "a": ("o", "u"), "r": ("n",),
}
LIGATURES = re.compile("[ﬀ-ﬆ]")
HYPHEN = re.compile(r"(\S*[^\W_])[-‐‑­¬]\s*$")
#: Tokens that mix letters and digits by nature: formulas, units, versions, ranges, ordinals.
BY_NATURE = re.compile(r"^(?:v?\d+(?:[.,:/-]\d+)*[a-z]{0,2}|[a-z]{1,2}\d{1,3}|\d+(?:st|nd|rd|th)|[a-z]\d[a-z]|v\d.*|\W*)$")
DIGITS = "[0-9OoIlSBZ]{1,5}"
NUMBER = re.compile(rf"^([-–—~•*|]*)\s*([\[(]?)\s*((?:page|p\.?|pg\.?)?)\s*({DIGITS}|[ivxlcdm]{{1,8}})(\s*(?:of|/)\s*{DIGITS})?\s*([\])]?)\s*[-–—~•*|]*$", re.I)
BESIDE = re.compile(rf"^({DIGITS})\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}({DIGITS})$")
FOLD = str.maketrans("0159683cf|", "oisgbbbeti")


def folded(text: str) -> str:
    """Letters and digits of a line, lower case, with what is often confused made equal."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(c for c in text.translate(FOLD) if c.isalnum()).replace("l", "i").replace("rn", "m")


def close(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) > 5 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)


def page_value(text: str) -> int | None:
    """The number of a page, from digits (with letters read for digits) or a Roman numeral."""
    if any(c.isdigit() for c in text):
        digits = text.translate(str.maketrans("OoIlSBZ", "0011582"))
        return int(digits) if digits.isdigit() else None
    worth = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    v = [worth.get(c) for c in text.lower()]
    if not v or None in v:
        return None
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0], strict=True))


def furniture(pages: list[list[str]], title: str) -> set[tuple[int, int]]:
    """(page, line) of page numbers and running headers.

    A page number stands alone on its line, in a mark of its own, at the edge of a page, or in a row of numbers that count
    up through the text (form feeds may be lost). A running header is the title, or a line of capitals or a line at
    a page's edge that comes again, small misreadings aside; a number may stand beside it.
    """
    flat = [(p, i, x.strip()) for p, lines in enumerate(pages) for i, x in enumerate(lines) if x.strip()]
    out: set[tuple[int, int]] = set()
    if not flat:
        return out
    new_page = [k == 0 or flat[k - 1][0] != p for k, (p, _, _) in enumerate(flat)]
    first = {k for k, x in enumerate(new_page) if x}
    last = {k - 1 for k in first if k} | {len(flat) - 1}
    numbers: list[tuple[int, tuple, int]] = []
    for k, (_, _, line) in enumerate(flat):
        m = NUMBER.match(line) if len(line) < 30 else None
        if m and bool(m[2]) == bool(m[6]) and (value := page_value(m[4])) is not None:
            numbers.append((k, (m[1], m[2], m[3].lower(), m[4].isalpha() and not m[4].isupper()), value))
    edge: set[int] = set()
    for n, (k, style, value) in enumerate(numbers):
        marked = bool(style[0] or style[1] or style[2])
        beside = [numbers[o] for o in (n - 1, n + 1) if 0 <= o < len(numbers)]
        counts = any(abs(v - value) == 1 and (v - value > 0) == (o > k) for o, _, v in beside)
        broken = k and HYPHEN.search(flat[k - 1][2]) is not None  # a word goes on below, so the number is no text
        headed = k + 1 < len(flat) and flat[k + 1][2].isupper() and len(flat[k + 1][2]) > 6
        if marked or counts or broken or headed or (len(flat) > 1 and (k in last or (k in first and k))):
            out.add(flat[k][:2])
            edge.add(k)
    edges = {k for k in range(len(flat)) if k not in edge and ((k in first and k) or k in last and len(first) > 1 or k - 1 in edge or (k - 1 in first and k - 1 in edge))}
    heads, named = [], folded(title)
    for k, (_, _, line) in enumerate(flat):
        if k in edge or len(line) > 100:
            continue
        m = BESIDE.search(line)
        bare = BESIDE.sub("", line).strip() if m else line
        letters = [c for c in bare if c.isalpha()]
        capitals = len(letters) > 3 and not any(c.islower() and c not in "àlo" for c in letters) and sum(c.isupper() for c in letters) > len(letters) / 2
        if capitals or m or k in edges or (named and abs(len(bare) - len(title)) < 4 and close(folded(bare), named)):
            heads.append((k, bare, folded(bare), capitals, m is not None))
    # lines that come again, by their distinct keys, so that a long text of equal headers is no square of work
    times, of_capitals = Counter(h[2] for h in heads), Counter(h[2] for h in heads if h[3])

    def again(key: str, among: Counter) -> bool:
        return among[key] > 1 or any(other != key and close(key, other) for other in among)

    for k, bare, key, capitals, numbered in heads:
        if not key:
            continue
        if named and len(named) > 5 and close(key, named) and not bare.endswith((".", ",", ";")):
            out.add(flat[k][:2])
        elif capitals and (numbered or k in edges or (k == 0 and len(flat) > 3 and " " in bare and not flat[1][2].isupper()) or again(key, of_capitals)):
            out.add(flat[k][:2])
        elif k in edges and k and bare.istitle() and len(bare.split()) < 5 and not bare.endswith((".", ",", ";")) and any(HYPHEN.search(flat[q][2]) for q in (k - 1, k - 2) if q >= 0):
            out.add(flat[k][:2])  # a name in capitals where a word should go on
        elif (numbered or k in edges) and not bare.endswith((".", ",", ";")) and again(key, times):
            out.add(flat[k][:2])
    return out


def is_scan(text: str) -> bool:
    """Whether a text is set in lines of a printed page: several lines, few of them longer than a page is wide."""
    lines = [x for x in text.replace("\f", "\n").split("\n") if x.strip()]
    return len(lines) > 3 and sum(len(x) > WIDE for x in lines) <= WIDE_SHARE * len(lines) and sorted(map(len, lines))[len(lines) // 2] >= 25


def core(token: str) -> str:
    """A token without what is neither letter, digit nor underscore at its ends."""
    if token.isalnum():
        return token
    begin, end = 0, len(token)
    while begin < end and not (token[begin].isalnum() or token[begin] == "_"):
        begin += 1
    while begin < end and not (token[end - 1].isalnum() or token[end - 1] == "_"):
        end -= 1
    return token[begin:end]


class Body:
    """The running lines of a text, with the words split at their ends put together."""

    def __init__(self, text: str, title: str):
        pages = [p.split("\n") for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\f")]
        self.gone = furniture(pages, title)
        self.removed = [pages[p][i].strip() for p, i in sorted(self.gone)]
        #: (token, first half, second half) of split words, (token, None, None) of others; None between paragraphs
        self.tokens: list[tuple[str, str | None, str | None] | None] = []
        carried, ended = "", True
        for p, page in enumerate(pages):
            for i, line in enumerate(page):
                if (p, i) in self.gone:
                    continue
                if not line.strip():
                    if not carried and self._at_end():
                        self.tokens.append(None)
                    continue
                if line.startswith("  ") and not carried and self._at_end():
                    self.tokens.append(None)
                words = line.split()
                if carried:
                    self.tokens.append((carried + words[0], carried, words[0]))
                    carried, words = "", words[1:]
                m = HYPHEN.search(line)
                if m and words and re.search(r"[^\W\d_]", m[1].rsplit("-", 1)[-1]):
                    carried = m[1]
                    words = words[:-1]
                self.tokens += [(w, None, None) for w in words]
        if carried:
            self.tokens.append((carried + "-", None, None))

    def _at_end(self) -> bool:
        return bool(self.tokens) and self.tokens[-1] is not None and self.tokens[-1][0].rstrip("\"”’)")[-1:] in ".!?:"


class Corrector:
    """Finds the right spelling of a word: a Levenshtein automaton run through a trie of the vocabulary, candidates ranked by context."""

    def __init__(self, counts: dict[str, tuple[int, int]], neighbours: np.ndarray):
        #: word -> (texts it stands in, those of them that are no scans)
        self.counts, self.neighbours = counts, neighbours
        self.trie: dict = {}
        for w, (n, clean) in counts.items():
            if (clean or n >= LEAST_TEXTS) and w.replace("-", "").isalpha() and w.isascii():
                node = self.trie
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = n
        self.known: dict[str, list[tuple[float, str, int]]] = {}

    def __reduce__(self):  # the trie is made again where the corrector arrives
        return Corrector, (self.counts, self.neighbours)

    def candidates(self, word: str, most: float = 2.0) -> list[tuple[float, str, int]]:
        """(cost, word, texts) of every vocabulary word within `most`: a known confusion costs 1, any other edit 1.7.

        The automaton's state is the set of places in `word` with their least costs; a step along a letter of
        the trie, or along two for a confusion of pairs, moves all of them, and a branch without a place ends.
        """
        if word in self.known:
            return self.known[word]
        n, found = len(word), {}

        def closed(state: dict[int, float]) -> dict[int, float]:
            for i in range(n):  # letters of the word that stand for nothing
                if i in state and state[i] + 1.7 <= most and state[i] + 1.7 < state.get(i + 1, 9):
                    state[i + 1] = state[i] + 1.7
            return state

        def walk(node: dict, before: dict[int, float], last: str, state: dict[int, float], made: str) -> None:
            if "" in node and n in state:
                found[made] = (state[n], made, node[""])
            for c, child in node.items():
                if not c:
                    continue
                after: dict[int, float] = {}
                for i, cost in state.items():
                    moves = [(i, cost + 1.7)]
                    if i < n:
                        moves.append((i + 1, cost + (0 if word[i] == c else 1.7)))
                    moves += [(i + len(r), cost + 1) for r in CONFUSIONS.get(c, ()) if word.startswith(r, i)]
                    for j, x in moves:
                        if x <= most and x < after.get(j, 9):
                            after[j] = x
                for r in CONFUSIONS.get(last + c, ()):
                    for i, cost in before.items():
                        if cost + 1 <= most and word.startswith(r, i) and cost + 1 < after.get(i + len(r), 9):
                            after[i + len(r)] = cost + 1
                if after:
                    walk(child, state, c, closed(after), made + c)

        walk(self.trie, {}, "", closed({0: 0.0}), "")
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = sorted(found.values())
        return self.known[word]

    def texts(self, word: str) -> int:
        return self.counts.get(word, (0, 0))[0]

    def right(self, word: str, before: str = "", after: str = "", running: bool = False) -> str | None:
        """The right spelling of a lower-case word, or None where it stands as it is; a `running` word without counts stands in its own text alone."""
        if word.isascii() and word.isalpha():  # most words
            own, clean = self.counts.get(word, (1, 0) if running and len(word) < LONG else (0, 0))
            if clean or len(word) < 4:
                return None
        plain = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        odd = plain != word or any(c.isdigit() for c in plain) or "|" in plain
        if BY_NATURE.match(plain) and plain == word:
            return None
        own, clean = self.counts.get(word, (1, 0) if running and len(word) < LONG else (0, 0))
        if not odd and (clean or len(word) < 4):
            return None
        if plain != word and self.texts(plain) >= LEAST_TEXTS:
            return plain
        found = [x for x in self.candidates(plain) if x[1] != word and (odd or x[0] <= 1 or (x[0] <= 2 and not own - 1))]
        if not odd:
            found = [x for x in found if x[2] >= max(3, 15 * own)]
        if not found:
            return plain if plain != word and plain.isalpha() else None
        return min(found, key=lambda x: (6 * x[0] - log(x[2]) - log(1 + self.near(before, x[1])) - log(1 + self.near(x[1], after)), x[1]))[1]

    def near(self, a: str, b: str) -> int:
        return int(self.neighbours[cell(a, b)]) if a and b and len(self.neighbours) else 0

    def joined(self, first: str, second: str) -> str:
        """The word of two halves, lower case: with the hyphen where that form is the one in use."""
        a, b = core(first).lower(), core(second).lower()
        one, two = a + b, f"{a}-{b}"
        if self.texts(two) > self.texts(one):
            return two
        if self.texts(one):
            return one
        fixed, compound = self.right(one), self.right(two) if "-" in two else None
        if compound and "-" in compound and (not fixed or self.texts(compound) > self.texts(fixed)):
            return compound
        return fixed or one


def cell(a: str, b: str) -> int:
    from zlib import crc32

    return crc32(f"{a} {b}".encode()) % CELLS


def repair(text: str | None, title: str, corrector: Corrector) -> tuple[str | None, list[tuple[str, str]]]:
    """(repaired text, what was done as (kind, value)); a text that is no scan keeps its lines, only ligatures are written out."""
    if text is None or not text.strip():
        return text, []
    if not is_scan(text):
        if not LIGATURES.search(text):
            return text, []
        found = [core(w).lower() for w in text.split() if LIGATURES.search(w)]
        return LIGATURES.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text), [("char", unicodedata.normalize("NFKC", w)) for w in found]
    body = Body(text, title)
    done = [("removed", x) for x in body.removed]
    out, words = [], []
    low = [core(t[0]).lower() if t else "" for t in body.tokens]
    for k, t in enumerate(body.tokens):
        if t is None:
            if words:
                out.append(" ".join(words))
                words = []
            continue
        token, first, second = t
        if first is not None:
            word = corrector.joined(first, second)
            done.append(("joined", word))
            halves = core(first).lower() + core(second).lower()
            if word.replace("-", "") != halves.replace("-", ""):
                done.append(("char", word))
            whole = core(token)
            words.append(token.replace(whole, word.capitalize() if whole[:1].isupper() else word))
            continue
        word = low[k]
        if not word.isascii() and LIGATURES.search(word):
            right = unicodedata.normalize("NFKC", word)
            right = corrector.right(right) or right
        else:
            right = corrector.right(word, low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else "", running=True) if word else None
        if right and right != word:
            done.append(("char", right))
            whole = core(token)
            right = right.upper() if whole.isupper() and len(whole) > 1 else right.capitalize() if whole[:1].isupper() else right
            token = token.replace(whole, right)
        words.append(token)
    if words:
        out.append(" ".join(words))
    return "\n\n".join(out), done


def _words_of(text: str, title: str) -> tuple[bool, list[str], set[str]]:
    """(whether it is a scan, its words, the forms besides them that `repair` looks up: of split words and of ligatures)."""
    scan = is_scan(text)
    if not scan:
        return False, [core(w).lower() for w in text.split()], set()
    tokens = Body(text, title).tokens
    words = ["" if t is None or t[1] is not None else core(t[0]).lower() for t in tokens]
    forms = {unicodedata.normalize("NFKC", w) for w in words if not w.isascii() and LIGATURES.search(w)}
    for t in tokens:
        if t is not None and t[1] is not None:
            a, b = core(t[1]).lower(), core(t[2]).lower()
            forms |= {a + b, f"{a}-{b}"}
    return True, words, forms | {"".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in forms}


def fit_corrector(texts: DataFrame) -> Corrector:
    """Vocabulary and neighbour counts from all texts; words halved by line ends are left out.

    (word, texts, texts that are no scans) is counted in the cluster. The words of at least LEAST_TEXTS texts, or of
    one that is no scan, reach the driver with CELLS counters of word pairs, and of the others those that are a form some text
    looks up besides its words; more than VOCABULARY in all are an error, none is dropped.
    """

    names = ["word", "cell", "n", "clean", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        near = np.zeros(CELLS, dtype=np.int64)

        def words_so_far() -> pa.RecordBatch:
            columns = [list(counts), [0] * len(counts), *([v[k] for v in counts.values()] for k in range(3))]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            for text, title in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text or not text.strip():
                    continue
                scan, words, forms = _words_of(text, title or "")
                for w in forms:
                    if w and len(w) < LONG:
                        counts.setdefault(w, [0, 0, 0])[2] = 1
                for w in set(words):
                    if w and len(w) < LONG:
                        own = counts.setdefault(w, [0, 0, 0])
                        own[0] += 1
                        own[1] += not scan
                for a, b_ in zip(words, words[1:], strict=False):
                    if a and b_:
                        near[cell(a, b_)] += 1
                if len(counts) > COUNTED:
                    yield words_so_far()
        yield words_so_far()
        filled = np.flatnonzero(near)
        nothing = pa.array(np.zeros(len(filled), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(filled), pa.string()), pa.array(filled), pa.array(near[filled]), nothing, nothing], names)

    counted = stored(texts.mapInArrow(run, "word string, cell long, n long, clean long, form long").groupBy("word", "cell").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"), F.max("form").alias("form")), "words")
    words = counted.filter(F.col("word").isNotNull() & ((F.col("clean") > 0) | (F.col("n") >= LEAST_TEXTS) | ((F.col("form") > 0) & (F.col("n") > 0))))
    if (many := words.count()) > VOCABULARY:
        raise ValueError(f"{many} words, more than the {VOCABULARY} that one vocabulary may hold")
    near = np.zeros(CELLS, dtype=np.int64)
    for r in counted.filter(F.col("word").isNull()).select("cell", "n").toLocalIterator():
        near[r.cell] = r.n
    return Corrector({r.word: (r.n, r.clean) for r in words.toLocalIterator()}, near)


def repaired(submissions: DataFrame, key: str = "submission_id", text: str = "text_content", title: str = "title") -> DataFrame:
    """(key, text, done array<struct<kind, value>>) of each row: the repaired text and what was repaired.

    Null and blank texts stay as they are with nothing done; so do texts that are no scans. The corrector, of fixed
    size, is sent to the tasks; a text is never shuffled. A row that is repeated is answered each time.
    """
    rows = submissions.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"))
    sent = submissions.sparkSession.sparkContext.broadcast(fit_corrector(rows.select("text", "title")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        for whole in batches:
            for b in pieces(whole, 1):
                got = [repair(t, n or "", sent.value) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([[{"kind": k, "value": v} for k, v in g[1]] for g in got], kind)], [key, "text", "done"])

    return rows.mapInArrow(run, f"`{key}` long, text string, done array<struct<kind:string,value:string>>")


def repairs(submissions: DataFrame, key: str = "submission_id", text: str = "text_content", title: str = "title") -> DataFrame:
    """(key, kind, value), distinct: words joined, words corrected and lines removed in each text."""
    done = repaired(submissions, key, text, title).select(key, F.explode("done").alias("d"))
    return done.select(key, "d.kind", "d.value").distinct()
