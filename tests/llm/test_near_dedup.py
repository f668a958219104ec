import random
import re

import numpy as np
import pyarrow as pa

from fluvia.llm import near_dedup as d
from fluvia.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(n_groups=12):
    rng = random.Random(4)
    out = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One TWO"), (5, "one two three four"), (6, "x " * 300)]
    i = 10
    for g in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 80, 300]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 18))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
            out.append((i, " ".join(words)))
            i += rng.randrange(1, 4)
            if rng.random() < 0.2:
                base = words  # chains: links through others
    passage = " ".join(f"p{k}" for k in range(60))
    out += [(i + 1 + k, f"{passage} " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(10, 40)))) for k in range(40)]
    out += [(900 + k, out[20][1]) for k in range(30)]
    return out


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    before = d.BLOCK_ROWS, d.STAR_ROWS, d.BROADCAST_ROWS, d.BROADCAST_IDS
    for width, limits in ((4, before), (5, (3, 2, 0, 0))):
        d.BLOCK_ROWS, d.STAR_ROWS, d.BROADCAST_ROWS, d.BROADCAST_IDS = limits
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in d.near_duplicates(df, width).collect()}
        d.BLOCK_ROWS, d.STAR_ROWS, d.BROADCAST_ROWS, d.BROADCAST_IDS = before
        assert got == brute(rows, width)


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, d.near_duplicates(df, 4).collect())) == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]
    assert d.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, None), (8, long), (6, long + " end"), (7, long.replace("w59", "v59"))]
    got = d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(str, [(None, None, True), (3, 3, True), (4, 3, False), (None, None, True), (8, 6, False), (6, 6, True), (7, 6, False)]))


def test_pairs_within_the_threshold_share_a_bucket():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (300, d.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    most = 2 * d.SYMBOLS // d.CHUNK - 1
    for row in b:
        row[rng.permutation(d.SYMBOLS)[:most]] ^= 1
    assert all(len(np.intersect1d(x, y)) for x, y in zip(d.bucket_keys(a), d.bucket_keys(b)))


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(2000)]
    x, y = (next(d.shingle_sets(pa.array([" ".join(w)]), 4)) for w in (words[:1500], words[300:1800]))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((d.signature(x) == d.signature(y)).mean() - j) < 0.2


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
