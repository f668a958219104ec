import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from fluvia.llm import transducer as t  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(t.byte_file())
    out.no_truncation()
    out.no_padding()
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), max_size=4), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_is_the_dictionary(words, others):
    a = t.Transducer(t.compiled(words))
    asked = [*words, *others]
    assert a.lookup(asked) == [words.get(w) for w in asked]


def test_suffixes_are_shared():
    a = t.Transducer(t.compiled({w: [1] for w in (b"tap", b"taps", b"top", b"tops")}))
    assert len(a.first) - 1 == 5


def test_damage_is_seen():
    data = bytearray(t.compiled({b"ab": [1]}))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        t.Transducer(bytes(data))


def test_merging_is_the_library(library):
    v = t.vocabulary(t.byte_file())
    for w in ("hello", " world", "antidisestablishmentarianism" * 9, " " * 300, "é" * 50, "\U0001f600", "0123456789" * 20, "=" * 200):
        assert v.merged(w.encode()) == [i for i in library.encode(w, add_special_tokens=False).ids] or len(t._SPLIT.findall(w)) > 1


def test_query_is_the_library(spark, tmp_path, library):
    texts = [None, "", "a", "the cat  sat\n\n on the\tmat ", "<|endoftext|>x<|endoftext|>", "It's we'LL 12 345!!  é́ ​\x00", "x" * 5000, "the cat sat " * 3000, "a"]
    spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in t.op10_transducer_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), r.doc_id
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert t.encoded(empty, t.build_lexicon(empty)).count() == 0


def test_small_lexicon_gives_the_same_ids(spark, library):
    docs = spark.createDataFrame([(i, f"some words and {i} more words") for i in range(50)], "doc_id long, text string")
    uri = t.build_lexicon(docs, most=3)
    for r in t.encoded(docs, uri).collect():
        assert r.ids == ",".join(map(str, library.encode(f"some words and {r.doc_id} more words").ids))
    assert np.array_equal(t.mapped(uri).begin, t.mapped(uri).begin)


def test_the_lexicon_holds_no_more_than_asked(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "aa bb bb cc cc dd ee ee ee") for i in range(9)], "doc_id long, text string")
    for highest in (2, 10, 20, 10_000):
        monkeypatch.setattr(t, "HIGHEST_COUNT", highest)
        for most in range(8):
            words = t.frequent_words(docs, t.byte_file(), most)
            assert len(words) <= most
            assert most == 0 or " ee" in words
            assert most > 2 or " dd" not in words
