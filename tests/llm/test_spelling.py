"""Spelling variants against a brute-force version and the SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from fluvia.llm import spelling as sp

SF = "/root/testdata/sf0.01"


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def made():
    rng, letters = random.Random(4), "abcÀÿ×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "q" * 70]
    words = list(stems)
    for w in stems * 3:
        k, c = rng.randrange(len(w) + 1), rng.choice(letters)
        words.append(rng.choice((w[:k] + c + w[k:], w[: max(k - 1, 0)] + w[k:], w[:k] + c + w[k + 1 :])))
    texts = []
    for w in words:
        n = rng.choice((1, 4, 5, 6, 25, 40, 150, 700))
        texts += [" ".join(rng.choice((w, w.capitalize())) for _ in range(k)) + rng.choice((".", "'s", "3", "ﬁ")) for k in (n // 2, n - n // 2)]
    texts += [None, "", "...", texts[0], "long " + "running " * 20_000, "z" * 100_000]
    return [(None if i == 5 else 8 if i == 9 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", (400, 4))
def test_equals_brute_force(spark, made, most, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in made], "doc_id long, text string, word string, n int").repartition(3)
    if most == 4:
        monkeypatch.setattr(sp, "BROADCAST_ROWS", 0)
    expected = brute(made)
    assert rows_of(sp.variants(docs, most)) == expected
    assert sum(1 for r in expected if r[1]) > 10 and any(r[2] not in (r[0], r[1]) for r in expected)


def test_parts_flushes_and_scans_of_bounded_size(made, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([t for _, t in made], pa.string())], names=["doc_id", "text"])
    whole = Counter()
    for out in sp._count(iter([batch])):
        whole.update(dict(zip(*(c.to_pylist() for c in out.columns))))
    monkeypatch.setattr(sp, "PART_CHARACTERS", 50)
    monkeypatch.setattr(sp, "HELD_WORDS", 20)
    parts = list(sp._count(iter([batch])))
    again = Counter()
    for out in parts:
        for w, n in zip(*(c.to_pylist() for c in out.columns)):
            again[w] += n
    # a run that a text repeats beyond a part loses the same code point there, so nothing changes
    assert again == whole and len(parts) > 3
    rows = sorted((f"|f3:{w[:3]}", "f", 3, w, w, 5) for w in {w[:6] for w in whole if len(w) >= 6})
    filed = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in sp.FILED.split(", ")])
    found = lambda: sorted((a, b) for out in sp._scan(iter([filed.slice(i, 7) for i in range(0, len(rows), 7)])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    once = found()
    monkeypatch.setattr(sp, "SCAN_ROWS", 10)
    assert found() == once == sorted((a, b) for *_, a, _ in rows for *_, b, _ in rows if a[:3] == b[:3] and distance_one(a, b))


def test_every_pair_comes_once(spark, made):
    words = spark.createDataFrame([(r[0], r[3]) for r in brute(made)], "word string, n long")
    pairs = sp.near_words(words, 4).select("word", "near").collect()
    assert len(pairs) == len(set(pairs)) == sum(r[4] for r in brute(made))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(empty).count() == 0
    assert sp.variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({sp.SQL})").fetchall()
    assert rows_of(sp.op11_spelling_variants(spark, SF)) == sorted(expected)
