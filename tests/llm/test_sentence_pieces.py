"""Agenda encoding against the sentencepiece library, on odd texts and a whole table."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from fluvia.llm import sentence_pieces as sp

ODD = [
    "", " ", "   ", "a", " a", "  a  b ", "\n", "\n\n", " \n ", "a\nb", "a \n b", "\t\ta", "a\r\nb", "a▁b", "▁", "▁▁ x", "a\0b", " x", "　x", "😀😀 x", "é ﬁ Ａ",
    "<s> </s> <unk> <0x0A>", "�", "​z", "the" * 50, "a" * 5000, "ab" * 3000, " " * 1000 + "x" + " " * 37, "1234567890.12,34", "https://a.b/c?d=e&f=g", "日本語の文 と 한국어", "x" + "͸" * 3,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.piece_file())


def _random_texts(n: int) -> list[str]:
    rng, letters = random.Random(5), "aaabcdeeethns  \n▁.,'\"(0123é😀ß中́\t"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def encoded(e, texts):
    ids, at = e.encode(pa.array(texts, pa.string()))
    return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


def test_agenda_and_decoding_equal_the_library(library):
    texts = ODD + _random_texts(400)
    for text, ids in zip(texts, encoded(sp.Encoder(sp.piece_file()), texts)):
        assert ids.tolist() == library.encode(text), text
        assert sp.pieces_of(sp.piece_file()).decoded(ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(library):
    rng, n = random.Random(3), library.get_piece_size()
    cases = [[5, 236], [0], [1, 2], [259], [229], [229, 153], [229, 153, 132, 300], [300, 0, 301], [1, 262, 262], [243, 162, 300], [198, 172, 198], [259, 262], [0, 262], [35, 262], [1, 229, 262]]
    cases += [[rng.choice((rng.randrange(n), rng.randrange(259), 262)) for _ in range(rng.randrange(12))] for _ in range(500)]
    for ids in cases:
        assert sp.pieces_of(sp.piece_file()).decoded(np.array(ids, np.int32)) == library.decode(ids), ids


def test_a_full_cache_changes_nothing(library):
    e = sp.Encoder(sp.piece_file(), most_parts=5, kept_parts=2)
    for text in ["one two three four", "five six seven eight nine", "one nine", "two\nten"]:
        assert encoded(e, [text])[0].tolist() == library.encode(text)


def test_another_result_of_the_library_is_an_error(library):
    e = sp.Encoder(sp.piece_file())
    with pytest.raises(ValueError, match="other ids"):
        e.check([" the"], [b"\1\0\0\0"])


def test_rows_of_any_kind(spark, library):
    texts = [*ODD, None, "same", "same", "word " * 60_000, "y" * 300_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = sp.encoded(docs)
    found = {r.doc_id: r.ids for r in rows.collect()}
    assert found == {None if i == 3 else i: library.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sp.decoded(rows).collect()}
    assert back == {None if i == 3 else i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}
    assert sp.encoded(docs.limit(0)).count() == 0
    assert sp.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in sp.op13_piece_agenda(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert found[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
