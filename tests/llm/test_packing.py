import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from fluvia.llm import packing as p  # noqa: E402
from fluvia.llm.word_tokens import END_ID, WordTokenizer, word_file  # noqa: E402


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_each_id_lies_in_one_piece_and_one_window_is_padded(lengths):
    found = p.packed(lengths)
    spans = sorted((d, s, n) for _, pieces in found for d, s, n in pieces)
    want = dict.fromkeys(range(len(lengths)), 0)
    for d, s, n in spans:
        assert s == want[d] and n > 0
        want[d] += n
    assert [want[i] for i in range(len(lengths))] == lengths
    padded = [w - sum(n for *_, n in pieces) for w, pieces in found]
    assert min(padded, default=0) >= 0 and sum(x > 0 for x in padded) <= 1


def test_steps_are_full_and_the_last_ones_alike():
    windows = [random.Random(1).choice(p.WINDOWS) for _ in range(500)]
    steps = p.Steps(7)
    full = [x for i, w in enumerate(windows) for x in steps.add(w, (i, w))]
    last = [*steps.end()]
    assert sorted(i for _, (i, _) in full + last) == [*range(500)]
    by = {}
    for s, (_, w) in full + last:
        by.setdefault(s, []).append(w)
    assert sorted(by) == [*range(7, 7 + len(by))]
    begun = {s for s, _ in last}
    assert all(len(set(by[s])) == 1 and sum(by[s]) == p.STEP_TOKENS for s in by if s not in begun)
    sums = [sum(by[s]) for s in begun]
    assert max(sums) <= p.STEP_TOKENS and max(sums) - min(sums) <= max(p.WINDOWS)
    assert [*p.Steps().end()] == []


def test_word_by_word_ids_are_the_library_ids():
    t = WordTokenizer(word_file())
    texts = ["", "Straße, À. ÀÉ ÿ, ÷ × don. x.y a,b .", "é ́x a\x85b c", "<|endoftext|> a<|startoftext|>b <|endoftext |>", "ΣΑΣ ΟΔΟΣ. İI", "it's I'LL don't", "１２３ ½ \x1cy", "long" * 3000, " \t\x0b\x0ca\r\n\n b\x1fc\x85 ", "\u2003x\u3000y\xa0z"]
    for text, ids in zip(texts, t.batch(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == [*t.library.encode(text, add_special_tokens=False).ids, END_ID]
    ids, at = t.encoded(pa.array([None, *texts, None], pa.string()).slice(3, 5))
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == t.batch(texts)[2:7]
    assert t.encoded(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_share_the_ids_of_their_pieces():
    t = WordTokenizer(word_file())
    t.batch(["abc### Abc, abc%%% ABC abc", "ÀBC àbc7 7"])
    assert sorted(x.decode() for x in t.known) == sorted(["abc", "###", ",", "%%%", "àbc", "7"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZéÀß×÷ÿ'.,#<|>_7 \n\x1f\x7fªΣ\u0301\u2003"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4), st.integers(0, 5))
def test_pieces_of_any_words_are_the_library_ids(texts, most):
    t = _small
    t.most_pieces, t.kept_pieces = most, most // 2
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, t.batch(texts)):
            assert np.frombuffer(ids, np.uint32).tolist() == [*t.library.encode(text, add_special_tokens=False).ids, END_ID]


_small = WordTokenizer(word_file())


def test_query_covers_every_id(spark, tmp_path):
    texts = [None, "", "a b c", "word " * 9000, *(f"doc {i} " * (i * 7 % 400) for i in range(120)), "a b c"]
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = p.op2_hierarchical_packing(spark, str(tmp_path)).collect()
    t = WordTokenizer(word_file())
    ids = {i: np.array([*t.library.encode(x or "", add_special_tokens=False).ids, END_ID], np.uint32) for i, x in enumerate(texts)}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
        assert filled[r.sequence_id] <= r.window
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
