import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvia.llm import pii as p


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0159()é\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert p.base_spans(text) == brute_base(text)


def test_field_recovers_held_out_texts():
    codes, texts, tags = p.tagged(p.made_table(300, seed=77))
    got = p.Field(p.default_weights()).decode(codes, texts)
    assert (got == tags).mean() > 0.985
    assert (got[tags == 0] == 0).mean() > 0.99


def test_runs_decode_as_the_whole_chain():
    f = p.Field(p.default_weights())
    rng = np.random.default_rng(3)
    pool = np.unique(p.tagged(p.made_table(200, seed=5))[0])
    for n in (1, 2, 4, 5):
        codes = rng.choice([*pool, p.PLAIN, p.PLAIN], n)
        texts = np.zeros(n, np.int64)
        before, after = f.neighbours(codes, texts)
        emit = f.scores(codes, before, after)
        best = max(itertools.product(range(len(p.TAGS)), repeat=n), key=lambda y: sum(emit[i, t] for i, t in enumerate(y)) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(f.decode(codes, texts)) == best


def test_query_on_odd_texts(spark, tmp_path):
    texts = [None, "", "plain words only", "é a.b@c.de, +1 (375) 555-4393 x", "4863730426282943 and 1.2.3.4 and 1.2.3.400", "password=e3b3ed3cc8548923d6 é", "1 " * 20_000, "a@b " * 5000, "é a.b@c.de, +1 (375) 555-4393 x"]
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in p.op8_pii_crf(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(p.joined(base).encode()).hexdigest()
        assert set(filter(None, p.joined(base).split(","))) <= set(r.spans.split(","))
    assert rows[2].spans == "" and rows[5].spans == "secret:0:27"
    assert p.detected(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a.b@c.de, +1 (375) 555-4393."), (2, None), (3, "clean text")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", p.redacted("text").alias("t")).collect()}
    assert got == {1: "é [EMAIL], [PHONE].", 2: None, 3: "clean text"}


def test_training_from_a_table(spark):
    rows = [(text, [(a, p.KINDS[k], b) for a, k, b in spans]) for text, spans in p.made_table(60)] + [(None, None), ("no spans", None), ("é", [])]
    table = spark.createDataFrame(rows, p.LABELLED)
    assert sorted(p.labelled_rows(table)) == sorted([*p.made_table(60), ("no spans", [])])
    docs = spark.createDataFrame([(1, "token=e3b3ed3cc8548923d6 now")], "doc_id long, text string")
    assert p.detected(docs, table).first().spans == "secret:0:24"
    assert p.weights_of(spark.createDataFrame([], p.LABELLED)) is p.default_weights()


#: Texts that no generator made, with each span in brackets and its kind.
WRITTEN = [
    "Reach [email:jane.doe@mail.example.org] or [email:sales-2@shop.example.co.uk], office hours 9-17.",
    "Card [card:4111.1111.1111.1111], order 20240117-8831, total $1,299.00",
    "paid with [card:4012888888881881] on 2024-03-09T10:11:12Z",
    "call [phone:+44 20 7946 0958] or [phone:+1 (212) 555-0199].",
    "front desk [phone:(415) 555-0132], room 1204",
    "host [ip:192.168.10.24] answered, kernel 5.15.0-91, mask 255.255",
    "export [secret:API_KEY=9f8e7d6c5b4a39281706] now",
    "set [secret:password=0123abcd4567ef89]\"### then restart",
    "commit 3f2b8c9d1e4a5b6c7d8e9f0a1b2c3d4e5f607182 fixes #4412",
    "id 550e8400-e29b-41d4-a716-446655440000 and digest d41d8cd98f00b204e9800998ecf8427e",
    "serial 1234567812345678 isn't a card, nor is 12345678901234567890123456",
    "x=12, y=345 in section 3.2.1 (page 77), see https://pages.example.org/a?id=1234567",
    "twice [card:4111111111111111]  [card:4012888888881881] 7",
]


def parsed(text):
    spans, plain, at = [], "", 0
    for m in re.finditer(r"\[(email|ip|card|phone|secret):([^\]]*)\]", text):
        plain += text[at : m.start()]
        spans.append((len(plain), p.KINDS.index(m[1]), len(plain) + len(m[2])))
        plain, at = plain + m[2], m.end()
    return plain + text[at:], spans


def test_quality_by_kind():
    field = p.Field(p.default_weights())
    for table in ([parsed(t) for t in WRITTEN], p.made_table(400, seed=77)):
        for kind, (precision, recall, n) in p.quality(field, table).items():
            assert n and precision >= 0.75 and recall >= 0.75, (kind, precision, recall, n)


def test_hashes_and_unchecked_numbers_are_no_cards():
    texts = ["3f2b8c9d1e4a5b6c7d8e9f0a1b2c3d4e5f607182", "1234567812345678", "4" * 40, "5500 0000 0000 0004", "1234.5678.1234.5678"]
    spans = [all_ for _, all_ in p.find(pa.array([f"number {t} here" for t in texts]), p.Field(p.default_weights()))]
    assert spans == [[], [], [], [(7, 2, 26)], []]


def test_many_spans_in_a_long_text():
    text = "é " + "4111.1111.1111.1111 and password=0123abcd4567ef89, " * 20_000
    (base, spans), = p.find(pa.array([text]), p.Field(p.default_weights()))
    assert base == [] and len(spans) == 40_000 and {text[a:b] for a, _, b in spans} == {"4111.1111.1111.1111", "password=0123abcd4567ef89"}


def test_empty_batch():
    assert p.find(pa.array([], pa.string()), p.Field(p.default_weights())) == []
