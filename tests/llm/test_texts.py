"""Scan repair, neighbours, main content, encoding, contamination and reading level against brute force, exact results and odd inputs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.llm import contamination, encoding, main_content, neighbours, reading_level, scan_repair

VOCABULARY = os.environ.get("GRAINFIELD_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"

SCAN = (
    "The capital of the province was restored by\nworkers during the winter, and the seaso-\nnal market moved to the harbour. The open-\nended lease of the harbour was signed by the\ncouncil. The table lists H2O and version v2.0.\n- 1 -\n"
    "\x0cA HISTORY OF THE PR0VINCE\n\nThe harbour was th1s year rebuilt, and the coun¬\ncil met in the market. The ﬁrst harbour of the\nprovince was small and the market was large.\n- 2 -\n"
    "\x0cA HISTORY OF THE PROVINCE\nThe council of the province met near the har-\n- 3 -\n\x0cA HISTORY OF THE PROVINCE\n\nbour of the capital during the winter again.\n- 4 -"
)
CLEAN = "This seasonal market of the province and the open-ended lease of the harbour: the first council of the capital was this year restored during the winter by workers of the large market near the small harbour again."


def test_scan_repair(spark):
    rows = [(1, SCAN, "A history of the province", "k"), (2, CLEAN, None, "k"), (3, CLEAN, "", "k"), (4, None, None, None), (5, " \n\x0c ", "x", "k"), (6, "", "x", "k"), (1, SCAN, "A history of the province", "k")]
    df = spark.createDataFrame(rows, "submission_id long, text_content string, title string, kind string")
    got = {(r.submission_id, r.kind, r.value) for r in scan_repair.repairs(df).collect()}
    want = {("joined", x) for x in ("seasonal", "open-ended", "council", "harbour")} | {("char", x) for x in ("this", "first")} | {("removed", x) for x in ("- 1 -", "- 2 -", "- 3 -", "- 4 -", "A HISTORY OF THE PR0VINCE", "A HISTORY OF THE PROVINCE")}
    assert got == {(1, *x) for x in want}
    text = {r.submission_id: r.text for r in scan_repair.repaired(df).collect()}
    assert text[2] == CLEAN and text[4] is None and text[5] == " \n\x0c " and text[6] == ""
    assert "seasonal market moved" in text[1] and "harbour of the capital" in text[1] and "PROVINCE" not in text[1] and "\n-" not in text[1]
    assert scan_repair.repairs(df.limit(0)).count() == 0


def test_candidates_are_complete():
    rng = random.Random(4)
    words = {"".join(rng.choice("abehilmnort") for _ in range(rng.randint(3, 8))): (5, 1) for _ in range(300)}
    c = scan_repair.Corrector(words, np.zeros(0, dtype=np.int64))

    def cost(a, b):
        """Least cost of reading the right word `a` as `b`, by the plain table of all places."""
        d = {(0, 0): 0.0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best = d.get((i, j), 99.0)
                if i and (i - 1, j) in d:
                    best = min(best, d[i - 1, j] + 1.7)
                if j and (i, j - 1) in d:
                    best = min(best, d[i, j - 1] + 1.7)
                if i and j:
                    best = min(best, d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 1.7))
                for n in (1, 2):
                    for r in scan_repair.CONFUSIONS.get(a[i - n : i], ()) if i >= n else ():
                        if j >= len(r) and b[j - len(r) : j] == r:
                            best = min(best, d[i - n, j - len(r)] + 1)
                d[i, j] = best
        return d[len(a), len(b)]

    for w in list(words)[:40]:
        bad = w.replace("h", "li", 1).replace("o", "0", 1)
        assert {(x[1], round(x[0], 6)) for x in c.candidates(bad)} == {(v, round(cost(v, bad), 6)) for v in words if cost(v, bad) <= 2.0}


def vectors(n, rng, dim=16):
    centres = rng.normal(size=(n // 5, dim))
    return [(centres[i % len(centres)] + rng.normal(size=dim) * 0.2) * rng.uniform(0.5, 3) for i in range(n)]


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(8)
    x = [v.astype(np.float32).tolist() for v in vectors(600, rng)]
    for i in range(40, 70):
        x[i] = x[40]  # a crowd of equal vectors
    rows = [(i, v, "r") for i, v in enumerate(x)]
    bad = [(1000, None, "r"), (1001, [], "r"), (1002, [0.0] * 16, "r"), (1003, [1.0] * 15, "r"), (1004, [float("nan")] + [1.0] * 15, "r"), (1005, [None] + [1.0] * 15, "r"), (1006, [float("inf")] + [1.0] * 15, "r"), (None, x[0], "r")]
    df = spark.createDataFrame(rows + bad + rows[:3], "id long, embedding array<float>, role string")
    m = np.array(x, dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    want = set()
    for i in range(len(x)):
        top = sorted(range(len(x)), key=lambda j: (-round(sims[i, j], 9), j))[:10]
        want |= {(min(i, j), max(i, j)) for j in top if sims[i, j] >= 0.9}
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, "id", "embedding", 16, 0.9).collect()}
    assert len(want & got) >= 0.9 * len(want) and all(sims[a, b] >= 0.9 - 1e-6 for a, b in got)
    crowd = {p for p in want if 40 <= p[0] < 70 and 40 <= p[1] < 70}
    assert crowd <= got
    found = neighbours.nearest(df, "id", "embedding", 16, 10, queries=F.col("id") % 10 == 0, lists=1, probes=15).collect()
    assert {r.a for r in found} == set(range(0, 600, 10))
    hits = sum(sims[r.a, r.b] >= np.sort(sims[r.a])[-10] - 1e-9 for r in found)
    assert hits >= 0.9 * 600
    assert neighbours.similar_pairs(df.limit(0), "id", "embedding", 16, 0.9).count() == 0


HEADS = ["History", "Use", "Origin", "Repair", "Design", "Colour", "Climate", "Trade", "Method", "Source", "Limit", "Theory", "Range", "Season"]


def page(i, rng):
    noun = rng.choice(["lamp", "river", "engine", "garden"])
    title = f"Notes on the {noun} of Town{'abcdefgh'[i % 8]}"
    para = lambda: " ".join(f"The {rng.choice(['old', 'new', 'small'])} {noun} of the town was {rng.choice(['seen', 'built', 'kept'])} near the {rng.choice(['mill', 'road', 'hill'])} for many years." for _ in range(3))
    lines = [("Skip to content", 0), ("Home | News | About", 0), ("We use cookies to make the Site better. Accept all.", 0), (title, 1), ("By Anna Smith", 0), (para(), 1), (f"{rng.choice(HEADS)} and {rng.choice(HEADS).lower()}", 1), (para(), 1), (f"- {rng.choice(HEADS).lower()} {noun} of the {rng.choice(HEADS).lower()}", 1), (para(), 1)]
    lines += [("Related pages", 0), (f"How to keep the {rng.choice(HEADS).lower()}", 0), (f"A guide to the {rng.choice(HEADS).lower()}", 0), ("Share this page: mail, print", 0), ("Copyright 2020 by the Site", 0), ("12 comments", 0)]
    return title, lines


def test_main_content_on_held_out_pages(spark):
    rng = random.Random(6)
    pages = [(i, f"host{i % 4}.example", *page(i, rng)) for i in range(240)]
    rows = [(i, s, t, "\n".join(x for x, _ in ls), 1) for i, s, t, ls in pages]
    rows += [(900, None, None, None, 1), (901, "host1.example", "", "", 1), (902, "", None, " \n\t", 1), (903, "host2.example", None, "Home | News\nCopyright 2021", 1)]
    df = spark.createDataFrame(rows, "id long, site string, title string, text string, line_no int")
    got = {(r.id, r.line_no) for r in main_content.furniture_lines(df).collect()}
    want = {(i, n) for i, _, _, ls in pages for n, (_, y) in enumerate(ls, 1) if not y}
    inside = {g for g in got if g[0] < 900}
    assert len(inside & want) >= 0.97 * len(want) and len(inside - want) <= 0.03 * len(want)
    assert {g for g in got if g[0] >= 900} == {(903, 1), (903, 2)}
    assert main_content.furniture_lines(df.limit(0)).count() == 0
    body = {r.id: r.body for r in main_content.main_text(df).collect()}
    assert body[900] is None and body[901] == "" and "cookies" not in body[0] and len(body) == len(rows)


def test_messages_are_exact_marginals():
    """Sum-product on the tree against the sum over all states."""
    from itertools import product

    rng = np.random.default_rng(3)
    lognorm = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
    model = main_content.TreeModel(rng.normal(size=main_content.FEATURES + 1), lognorm(rng.random(2)), lognorm(rng.random((2, 2))), lognorm(rng.random((2, 2))), lognorm(rng.random(2)))
    lines = ["Home", "A title", "A long line of text that is prose, with many words and a full stop at its end.", "Next"]
    f = main_content.Featurizer()
    feats, sections = f.page(lines, "A title", "x")
    got = model.marginals([(lines, "A title", "x")], f)[0]
    score = np.array([model.weights[c].sum() + model.weights[-1] for c in feats])
    ev = np.stack([-np.logaddexp(0, score), -np.logaddexp(0, -score)], axis=1) - model.prior
    total = np.zeros((len(lines), 2))
    for r in (0, 1):
        for z in product((0, 1), repeat=sections[-1] + 1):
            for y in product((0, 1), repeat=len(lines)):
                w = model.root[r] + sum(model.section[r, s] for s in z) + sum(model.line[z[sections[i]], y[i]] + ev[i, y[i]] for i in range(len(lines)))
                for i in range(len(lines)):
                    total[i, y[i]] += np.exp(w)
    assert got == pytest.approx(total[:, 1] / total.sum(axis=1))


def test_encoding_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", "a", "aaaaaaaaaaaaaaaa", "don't we'll I'M", "<|endoftext|>", "tabs\t\tand  spaces \n\n\n x ", "\x1c\x1d control \x00 \x85", "naïve Ünïcödé 日本語 🙂🏳️‍🌈 ﬁ", "x" * 5000, " ​﻿　 z", "12345 ½ ١٢٣"]
    texts += ["".join(rng.choice(" \n\tabcXYZ'.,0129éß日🙂") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(9000, None, "c"), (0, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encoding.encode_corpus(df, "doc_id", "text", VOCABULARY, most_bytes=300).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: list(r.ids) for r in got}
    assert by[9000] == []
    for i, t in enumerate(texts):
        assert by[i] == tok.encode(t, add_special_tokens=False).ids, t
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


ITEM = "Choose the best answer. The castle and the model were mapped by Fenan. The low-cost guild was placed by Osten near the river. What did Quar find?"


def test_contamination(spark):
    w = ITEM.split()
    half = " ".join(w[: len(w) // 2 + 3])
    cases = {
        1: f"Before. {ITEM} After.", 2: ITEM.upper().replace(" ", "\n\n"), 3: "<p>" + ITEM.replace("castle", "<b>cas</b>tle").replace("The", "Th​e") + "</p>", 4: ITEM.replace("e", "е"), 5: ITEM.replace("mapped", "map ped").replace("river", "ri-\nver"),
        6: half, 7: " ".join(w[: len(w) // 2 - 4]), 8: " ".join(x if i % 4 else "zzz" for i, x in enumerate(w)), 9: " ".join(w[::-1]), 10: None, 11: "", 12: "The castle and the model", 13: "x " * 20000 + ITEM, 14: " ".join([*w[:7], "one", "two", *w[7:]]),
    }
    rows = [(i, t, 7) for i, t in cases.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too few words here"), (1, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, items).collect()}
    assert got == {(i, 1) for i in (1, 2, 3, 4, 5, 6, 13, 14)}
    assert contamination.contaminated(docs, items.limit(0)).count() == 0 and contamination.contaminated(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        contamination.contaminated(docs, items, most_items=1)


def test_rolling_hashes_tell_stretches_apart():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    roll, s = contamination.Rolling(data), data.tobytes()
    for size in (1, 5, 17):
        h = roll.of(np.arange(len(data) - size + 1), size)
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(x, s[i : i + size]) == s[i : i + size]
        assert len(seen) == len({s[i : i + size] for i in range(len(s) - size + 1)})


def prose(band, rng, n=12):
    words = {"basic": ["cat", "dog", "red", "sun", "we", "ran"], "middle": ["market", "river", "report", "season", "because", "council"], "advanced": ["epistemic", "heuristics", "notwithstanding", "stochastic", "methodology", "invariants"]}[band]
    return " ".join(f"The {rng.choice(words)} of the {rng.choice(words)} was in the {rng.choice(words)} and it is a {rng.choice(words)}." for _ in range(n))


def test_reading_levels_on_held_out_documents(spark):
    rng = random.Random(2)
    truth = {i: rng.choice(reading_level.BANDS) for i in range(200)}
    rows = [(i, prose(b, rng).upper() if i % 9 == 0 else prose(b, rng), "basic") for i, b in truth.items()]
    other = {500: None, 501: "", 502: "  ", 503: "short text", 504: "for i in range(3):\n  x[i] = {'a': 1};\n" * 30, 505: "Die Brücke und der Fluss und die Karte seit dem Jahr und mit der Stadt " * 12, 506: "a\t1\t2\nb\t3\t4\n" * 40}
    rows += [(i, t, None) for i, t in other.items()] + [(600, prose("basic", rng, 4) + "\n\n" + prose("advanced", rng, 12), "basic")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, band string")
    labels = [(i, f"a{k}", b.title() if i % 5 == 0 else b) for i, b in list(truth.items())[:60] for k in (1, 2, 3)] + [(i, "a9", "basic") for i in range(0, 60, 7)] + [(3, "a8", None), (None, "a1", "basic"), (4, "a4", "unknown")]
    got = {r.doc_id: r.band for r in reading_level.reading_levels(docs, spark.createDataFrame(labels, "doc_id long, annotator string, band string")).collect()}
    held = [i for i in truth if i >= 60]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.97 * len(held)
    assert not set(other) & set(got) and got[600] == "advanced"
    none = spark.createDataFrame([], "doc_id long, annotator string, band string")
    assert reading_level.reading_levels(docs.limit(0), none).count() == 0 and reading_level.reading_levels(docs, none).count() >= 200
