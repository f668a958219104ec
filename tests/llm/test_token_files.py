import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from fluvia.llm import token_files as t  # noqa: E402
from fluvia.llm.word_tokens import END_ID, WordTokenizer, word_file  # noqa: E402


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 7), st.integers(0, 49407)), min_size=1, max_size=300), min_size=1, max_size=6))
def test_blocks_come_back(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    ranks = t.Ranks.of(np.concatenate(blocks))
    data = t.encode_blocks(blocks, ranks)
    again, _ = t.Ranks.from_bytes(ranks.to_bytes())
    assert [x.tolist() for x in t.decode_blocks(data, [len(b) for b in blocks], again)] == [b.tolist() for b in blocks]


def test_order_0_reaches_the_entropy_of_skewed_ids():
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 5001)
    p /= p.sum()
    ids = rng.permutation(49408)[rng.choice(5000, 60 * t.BLOCK_IDS, p=p)]
    data = t.group_bytes(ids)
    assert np.concatenate([*t.group_ids(data)]).tolist() == ids.tolist()
    c = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(data) / len(ids) < -(c * np.log2(c)).sum() + 1.5


def test_the_format_stays():
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.minimum(rng.zipf(1.3, 70_000), 49_000) + 3, np.tile(np.arange(50), 60), rng.integers(0, 49408, 901)])
    assert zlib.crc32(t.group_bytes(ids)) == 3070368145


def test_a_whole_vocabulary_fits():
    ids = np.concatenate([np.arange(200_000), np.zeros(50, np.int64)])
    assert np.concatenate([*t.group_ids(t.group_bytes(ids))]).tolist() == ids.tolist()


def test_blocks_are_independent_and_small_where_ids_repeat():
    rng = np.random.default_rng(2)
    same, noise = np.tile(rng.integers(0, 49408, 30), 60), rng.integers(0, 49408, t.BLOCK_IDS)
    ranks = t.Ranks.of(np.concatenate([same, noise]))
    data = t.encode_blocks([same, noise], ranks)
    assert t.decode_blocks([data[0]], [len(same)], ranks)[0].tolist() == same.tolist()
    assert len(data[0]) < 0.12 * 2 * len(same) and len(data[1]) < 1.15 * 2 * len(noise)


def test_damage_is_seen(spark, tmp_path):
    manifest, folder = t.write_files(spark.createDataFrame([(1, "some words here " * 50)], "doc_id long, text string"))
    path = folder.removeprefix("file://") + "/" + manifest.first().file
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError), pa.memory_map(path) as f:
        list(t.Reader(f, len(data)).blocks())


def test_files_of_many_groups(tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_IDS", 16)
    monkeypatch.setattr(t, "GROUP_BLOCKS", 3)
    docs = [(None if k == 2 else k, np.arange(k * 13 % 140, dtype="<u4")) for k in range(1, 40)]
    path = str(tmp_path / "x.cmx")
    with pa.OSFile(path, "wb") as f:
        out = t.Writer(f)
        for doc_id, ids in docs:
            out.add([doc_id], np.append(ids, 2).astype("<u4"), np.array([0, len(ids) + 1]))
        size = out.end()
    assert len(out.groups) > 20
    with pa.memory_map(path) as f:
        r = t.Reader(f, size)
        assert [None if x else i for i, x in zip(r.doc_ids.tolist(), r.nameless)] == [i for i, _ in docs]
        assert [*t._documents(r)] == [zlib.crc32(np.append(ids, 2).astype("<u4").tobytes()) for _, ids in docs]


def test_repeated_and_missing_ids(spark):
    rows = [(5, "b c"), (5, "a"), (5, "b c"), (None, "x y z"), (1, "q")]
    got = t.read_documents(*t.write_files(spark.createDataFrame(rows, "doc_id long, text string"), file_bytes=1)).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in got) == sorted((i or -1, n) for i, n in [(5, 3), (5, 2), (5, 3), (None, 4), (1, 2)])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert min(got, key=lambda r: r.start).doc_id is None


def test_query_gives_ascending_starts(spark, tmp_path):
    texts = [None, "", "a b", "word " * 9000, *(f"text {i} of some" * (i % 9) for i in range(80)), "a b"]
    rows = [(1000 - 7 * i, x, "clash") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in t.op5_token_files(spark, str(tmp_path)).collect()}
    w, at = WordTokenizer(word_file()), 0
    assert len(got) == len(rows)
    for doc_id, text, _ in sorted(rows):
        ids = np.array([*w.library.encode(text or "", add_special_tokens=False).ids, END_ID], np.uint32)
        assert tuple(got[doc_id]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert t.read_documents(*t.write_files(empty)).count() == 0
