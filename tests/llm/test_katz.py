import math
import random
import re
from collections import Counter

import pytest

from fluvia.llm import katz as k

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def good_turing(n):
    d = {r: 1.0 for r in range(1, k.K + 1)}
    share = (k.K + 1) * n[k.K + 1] / n[1] if n[1] else 1
    for r in d:
        if share < 1 and n[r] and n[r + 1]:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share)
            d[r] = x if 0 < x <= 1 else 1.0
    return d


class Brute:
    """The model by dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if not k.held_out(i)]
        self.c = Counter(w for t in train for w in t)
        self.pairs = Counter(p for t in train for p in zip([None, *t], t))
        self.total, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = good_turing(Counter(self.c.values())), good_turing(Counter(self.pairs.values()))
        self.unknown = 1 - sum(self.d1.get(n, 1) * n / self.total for n in self.c.values()) if self.total else 1
        self.scale = self.total
        if self.unknown < 1e-12 or not self.total:
            self.d1, self.scale, self.unknown = {}, self.total + 1, 1 / (self.total + 1)
        self.after = {}
        for (a, b), n in self.pairs.items():
            if n >= k.LEAST_PAIR:
                self.after.setdefault(a, {})[b] = n

    def p1(self, w):
        n = self.c[w] if w in self.c else 0
        return self.d1.get(n, 1) * n / self.scale if n else self.unknown

    def p(self, a, b):
        seen = self.after.get(a)
        if not seen:
            return self.p1(b)
        mass = sum(self.d2.get(n, 1) * n for n in seen.values())
        below = self.c[a] + 1 if mass > self.c[a] * (1 - 1e-9) else self.c[a]
        rest = 1 - sum(self.p1(w) for w in seen)
        if rest <= 1e-12:
            below = mass
        if b in seen:
            return self.d2.get(seen[b], 1) * seen[b] / below
        return (1 - mass / below) / rest * self.p1(b)


def hash_of(word):
    return sum(map(ord, word)) * 31


def corpus(n=150):
    rng = random.Random(3)
    words = [f"W{int(1 / (rng.random() + 0.01))}" for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words)]
        while len(text) < i % 60 + 1:  # a word mostly has one of two followers
            text.append(words[(hash_of(text[-1]) + rng.randrange(2)) % len(words)] if rng.random() < 0.7 else rng.choice(words))
        rows.append((i, " ".join(text)))
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "unseen-word only"), (904, "w1 " * 3000), (3, rows[3][1])]


def check(spark, rows):
    model = Brute(rows)
    got = k.scored(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k.held_out(r.doc_id), len(t), sum(w in model.c for w in t), model.total)
        assert r.base_score == pytest.approx(sum(math.log10((model.c[w] + 1) / (model.total + model.v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(model.p(a, b)) for a, b in zip([None, *t], t)))
    return model


def test_scores_match_a_brute_force_model_that_sums_to_one(spark):
    model = check(spark, corpus())
    for a in [None, "w1", "w2", "w50", "never"]:
        assert sum(model.p(a, b) for b in model.c) + model.p(a, "never seen") == pytest.approx(1)
    held = [tokens(t) for i, t in corpus() if k.held_out(i)]
    base = sum(math.log10((model.c[w] + 1) / (model.total + model.v + 1)) for t in held for w in t)
    assert sum(math.log10(model.p(a, b)) for t in held for a, b in zip([None, *t], t)) > base


def test_many_small_chunks_and_buckets(spark, monkeypatch):
    for name, value in (("CHUNK_BYTES", 500), ("BUCKET_BYTES", 300), ("BUCKET_TOKENS", 400)):
        monkeypatch.setattr(k, name, value)
    check(spark, corpus(60))


def test_without_training_or_rows(spark):
    held = [i for i in range(60) if k.held_out(i)]
    check(spark, [(i, "a b") for i in held])
    assert k.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_seen_once_are_in_the_model(spark):
    rows = corpus()
    train = [tokens(t) for i, t in rows if not k.held_out(i)]
    model = Brute(rows)
    model.after = {}
    for (a, b), n in Counter(p for t in train for p in zip([None, *t], t)).items():
        model.after.setdefault(a, {})[b] = n
    assert sum(n == 1 for n in model.pairs.values()) > 20 and model.d2[1] < 1
    texts = dict(rows)
    for r in k.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = tokens(texts[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(model.p(a, b)) for a, b in zip([None, *t], t)))


def test_rows_without_an_id_train(spark):
    rows = [(None, "a b c"), (None, "a b"), (6, "a b d")]
    got = k.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in got) == [(0, False, 3), (0, False, 4), (6, k.held_out(6), 4)]
    assert {r.train_tokens for r in got} == {7 + (0 if k.held_out(6) else 4)}


def test_the_session_keeps_its_rows_in_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    k.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert spark.conf.get(name) == before
