"""Blocks of lines over a site that is split over tasks, against plain counting."""

import random
from collections import defaultdict

import pytest

from grainfield.llm import repeated_lines


def plain(rows, min_docs, min_share, max_len):
    docs, seen = defaultdict(int), defaultdict(list)
    for site, i, keys in rows:
        docs[site] += 1
        real = [k for k in keys if k]
        for size in range(2, max_len + 1):
            for a in range(len(real) - size + 1):
                key = 0
                for v in real[a : a + size]:
                    key = (key * 1_000_003 + v) & 0xFFFFFFFFFFFFFFFF
                seen[site, key - (1 << 64) if key >> 63 else key, size].append((i, real[a + size] if a + size < len(real) else None))
    out = {}
    for (site, key, size), at in seen.items():
        n, after = len({i for i, _ in at}), {x for _, x in at}
        if len(at) > 1 and (size == max_len or None in after or len(after) > 1) and n >= min_docs and n >= min_share * docs[site] - 1e-9:
            out[site, key, size] = (n, docs[site])
    return out


@pytest.mark.parametrize("parts", ["1", "6"])
def test_blocks_do_not_depend_on_the_parts(spark, parts):
    rng = random.Random(4)
    rows = [("hot" if i % 5 else "small", i, [rng.choice([0, -3, 2, 2**62, 5]) for _ in range(rng.randint(0, 14))]) for i in range(60)]
    # nested blocks longer than the cut: nine lines on six pages, twelve on three of them
    rows += [("deep", 100 + i, list(range(1, 13 if i < 3 else 10)) + [900 + i]) for i in range(6)]
    # one block on six pages, each in a part of its own
    rows += [("thin", 200 + i, [11, 12, 13, 1000 + i]) for i in range(6)]
    pages = spark.createDataFrame(rows, "site string, id long, keys array<long>")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for docs, share, size in ((5, 0.2, 8), (2, 0.0, 3)):
            got = {(r.site, r.block, r.n_lines): (r.n_docs, r.site_docs) for r in repeated_lines.recurring_blocks(pages, docs, share, min_len=2, max_len=size).collect()}
            want = plain(rows, docs, share, size)
            assert len(want) > 10 and got == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
