"""Capping, near duplicates, rank aggregation and repeated lines against brute force and on odd inputs."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from grainfield.llm import capping, near_duplicates, rank_aggregation, repeated_lines


def test_capping_keeps_the_best_whatever_the_batches(spark):
    rng = random.Random(3)
    rows = [(None if i % 7 == 0 else f"s{i % 3}", rng.choice([None, float("nan"), 0.0, -1.0, 0.5, 0.5, round(rng.random(), 2)]), i) for i in range(300)]
    cap = 11
    state = capping.CapState(spark, cap)
    for b in range(3):
        state.absorb(spark.createDataFrame(rows[b * 100 : b * 100 + 100], "contributor string, quality double, id long"))
    got = {r.id for r in state.displaced().collect()}
    score = lambda q: q if q is not None and q > 0 else 0.0
    want = set()
    for c in {r[0] for r in rows}:
        want |= {r[2] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-score(r[1]), r[2]))[cap:]}
    assert got == want
    assert {r.id for r in state.kept.collect()} == {r[2] for r in rows} - want


def test_capping_goes_on_from_its_folder(spark, tmp_path):
    rows = [(f"s{i % 5}", float(i * 37 % 101), i) for i in range(200)]
    whole = capping.CapState(spark, 9)
    whole.absorb(spark.createDataFrame(rows, capping.STATE))
    for part in (rows[:90], rows[90:], [r for r in rows if r[0] == "s2"][:3]):
        state = capping.CapState(spark, 9, str(tmp_path / "state"))  # opened anew for each batch
        state.absorb(spark.createDataFrame(part, capping.STATE))
    assert state.version == 3 and {r.id for r in state.kept.collect()} == {r.id for r in whole.kept.collect()}
    again = capping.CapState(spark, 9, str(tmp_path / "state"))
    assert {r.id for r in again.displaced().collect()} == {r.id for r in whole.displaced().collect()}
    with pytest.raises(ValueError):
        capping.CapState(spark, 8, str(tmp_path / "state"))


def test_capping_of_nothing_and_with_clashing_columns(spark):
    empty = spark.createDataFrame([], "site string, q double, id long, contributor string, _c int")
    assert capping.cap_by_share(empty, "site", "q", "id", 0.1).displaced().count() == 0
    df = spark.createDataFrame([("a", 0.1 * i, i, "x", i) for i in range(20)] * 2, "site string, q double, id long, contributor string, _c int")
    assert sorted(r.id for r in capping.cap_by_share(df, "site", "q", "id", 0.5).displaced().collect()) == list(range(10))
    with pytest.raises(ValueError):
        capping.CapState(spark, 0)


def shingles(t, k):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("width", "t"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, width, t):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 90))] for _ in range(25)]
    rows = [(None,), ("",), ("  \n",), ("one two",), ("one two",)]
    for b in base:
        rows.append((" ".join(b),))
        for share in (0.02, 0.1, 0.3):
            rows.append((" ".join(x if rng.random() > share else rng.choice(vocab) for x in b).title(),))
    rows += [rows[9]] * 4  # a group of copies
    rows = [(i, r[0], "z", 0.5) for i, r in enumerate(rows)]
    df = spark.createDataFrame([*rows, (None, rows[9][1], "z", 0.5)], "id long, text string, fragment string, rep double")
    sets = {i: shingles(x, width) for i, x, *_ in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
    got = near_duplicates.near_duplicate_pairs(df, "id", "text", width, t).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want
    classes = near_duplicates.near_duplicate_classes(df, "id", "text", width, t).collect()
    assert sorted(r.id for r in classes if r.id is not None) == [r[0] for r in rows] and len(classes) == len(rows) + 1
    classes = [r for r in classes if r.id is not None]
    rep = {r.id: r.class_id for r in classes}
    links = {tuple(sorted((rep[a], rep[b]))) for a, b in want if rep[a] != rep[b]}
    for r in classes:
        assert r.n_links == sum(rep[r.id] in x for x in links)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicate_pairs(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_candidates_whatever_the_tasks_and_blocks(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(80)] for _ in range(40)]
    texts = [" ".join(x if rng.random() > 0.03 else rng.choice(vocab) for x in b) for b in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near_duplicates.gram_sets(df, 3)
    grams = {i: shingles(x, 3) for i, x in enumerate(texts)}
    true = {(a, b) for a, b in combinations(grams, 2) if 2 * len(grams[a] & grams[b]) >= len(grams[a] | grams[b])}
    for tasks, hot in ((12, 20_000), (204, 20_000), (2_004, 20_000), (12, 1)):  # with blocks of one text every shared n-gram has a grid
        got = {(r.a, r.b) for r in near_duplicates.candidate_pairs(sets, 0.5, tasks, hot).collect()}
        assert true <= got and len(got) <= 3 * len(true)


def test_rank_aggregation_matches_plain_ranks(spark):
    rng = random.Random(5)
    rows = [(q if q else None, i, rng.choice([None, float("nan"), 1.0, 2.0, rng.random()]), rng.random() * 1e-6, float(rng.randint(0, 3)), "x") for q in range(3) for i in range(17)]
    rows += rows[:6]
    df = spark.createDataFrame(rows, "g int, item int, a double, b double, c double, _s0 string")
    got = {(r.g, r.item): (r.rho, r.mean_rank) for r in rank_aggregation.robust_rank_aggregation(df, "g", "item", ["a", "b", "c"]).collect()}
    assert len(got) == 51
    for g in (None, 1, 2):
        own = {r[1]: r for r in rows if r[0] == g}
        for item, r in own.items():
            ranks = []
            for k in (2, 3, 4):
                v = [x[k] for x in own.values() if x[k] is not None and x[k] == x[k]]
                ranks.append((sum(x > r[k] for x in v) + (sum(x == r[k] for x in v) + 1) / 2) / len(own) if r[k] is not None and r[k] == r[k] else 1.0)
            s = sorted(ranks)
            rho = min(1.0, 3 * min(1 - (1 - s[0]) ** 3, 3 * s[1] ** 2 - 2 * s[1] ** 3, s[2] ** 3))
            assert got[g, item] == pytest.approx((rho, sum(s) / 3))
    first = rank_aggregation.first_of_each(rank_aggregation.robust_rank_aggregation(df, "g", "item", ["a", "b", "c"]), "g", "item").collect()
    assert len(first) == 3
    assert rank_aggregation.robust_rank_aggregation(df.limit(0), "g", "item", ["a"]).count() == 0


def test_repeated_lines_match_counts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lines = [f"Body line number {rng.choice('abcdefghijklmnop')}{i} text", "", "123"]
        if i % 3:
            lines.insert(0, rng.choice(["Skip to content", "  SKIP to content »", "skip TO content"]))
        if i % 5 == 0:
            lines += ["Share — this", "Copyright notice\r"]
        rows.append((i, "hot" if i < 90 else None if i < 100 else f"s{i % 2}", None if i == 3 else "" if i == 4 else "\n".join(lines), "k"))
    df = spark.createDataFrame(rows, "id long, host string, text string, keys string")
    keyed = repeated_lines.keyed_pages(df, F.col("host"), "id", "text")
    got = {(r.id, r.line_no) for r in repeated_lines.repeated_lines(keyed).collect()}
    key = lambda x: re.sub(r"[^a-z]", "", x.lower())
    want = set()
    for host in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == host]
        seen = {}
        for r in own:
            for k in {key(x) for x in (r[2] or "").split("\n")} - {""}:
                seen[k] = seen.get(k, 0) + 1
        for r in own:
            want |= {(r[0], n) for n, x in enumerate((r[2] or "").split("\n"), 1) if seen.get(key(x), 0) >= max(5, 0.2 * len(own))}
    assert got == want and got
    gone = repeated_lines.without_lines(df, spark.createDataFrame([(1, 1)], "id long, line_no int"), "id", "text")
    left = {r.id: r.text for r in gone.collect()}
    assert left[1] == "\n".join(rows[1][2].split("\n")[1:]) and left[3] is None and left[2] == rows[2][2]


def test_blocks_of_several_lines(spark):
    rows = [(i, "s", f"alpha {chr(97 + i)}\nfirst line\nsecond line\nthird line\nomega {chr(97 + i)}") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, host string, text string")
    keyed = repeated_lines.keyed_pages(df.coalesce(1), F.col("host"), "id", "text")
    got = {(r.n_lines, r.n_docs) for r in repeated_lines.recurring_blocks(keyed, min_len=2, max_len=8).collect()}
    assert (3, 8) in got


def test_suffix_array_against_sorting():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 60):
        ids = rng.integers(0, 4, n)
        seq = np.append(ids, 99) if n else ids
        sa, levels = repeated_lines.suffix_array(seq)
        assert sa.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
        lcp = repeated_lines.common_prefixes(sa, levels)
        for k in range(1, len(sa)):
            a, b = seq[sa[k - 1] :].tolist(), seq[sa[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
