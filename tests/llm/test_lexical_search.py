"""Threshold-seeded search against a brute-force ranking and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from fluvia.llm import lexical_search as ls

SF = "/root/testdata/sf0.01"


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k=10):
    """docs: (doc_id, text) rows in any order; items: (item_id, text)."""
    counts = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def made():
    rng = random.Random(2)
    words = ["the", "a", "of", *(f"w{i}" for i in range(300)), "É", "naïve", "日本", "x1"]
    pick = lambda n: [words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n)]
    texts = [rng.choice((" ", ", ", "-", "\n")).join(pick(rng.randrange(1, 60))) for _ in range(400)]
    texts += [texts[5]] * 30 + [None, "", " .,;", "THE The the", "É é", "one-word", "w1 " * 50_000, "a" * 300_000]
    docs = [(None if i == 7 else 3 if i in (8, 9) else i, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(pick(12))) for i in range(30)] + [(30, texts[5]), (31, None), (32, "..."), (33, "nowhere"), (34, "THE É"), (30, "w2"), (None, "the"), (35, "the")]
    return docs, items


def test_equals_a_brute_force_ranking(spark, made, monkeypatch):
    docs, items = made
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, term string").repartition(5)
    q = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, score int")
    expected = brute(docs, items)
    assert rows_of(ls.search(d, q)) == expected
    assert rows_of(ls.search(d, q, 3)) == brute(docs, items, 3)
    monkeypatch.setattr(ls, "BROADCAST_TERMS", 5)
    monkeypatch.setattr(ls, "BROADCAST_ROWS", 0)
    assert rows_of(ls.search(d, q)) == expected


def test_texts_are_read_in_parts(made, monkeypatch):
    monkeypatch.setattr(ls, "PART_BYTES", 20)
    for _, text in made[0]:
        parts = list(ls.parts_of(text or ""))
        assert [w.decode() for p in parts for w in p] == terms(text) and all(len(b" ".join(p)) < 60 or len(p) == 1 for p in parts)


def test_empty_tables(spark, made):
    docs, items = made
    d, q = spark.createDataFrame(docs[:20], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ls.search(d.limit(0), q).count() == 0
    assert ls.search(d, q.limit(0)).count() == 0
    assert ls.search(d.filter("text = 'none'"), q.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    expected = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({ls.SQL})").fetchall()
    assert rows_of(ls.op12_threshold_search(spark, SF)) == sorted(expected)
    assert len(expected) == 400
