import hashlib
import tracemalloc
import zlib

import numpy as np

from fluvia.llm import media as m


def test_companding_tables_follow_the_standard():
    mu, a = m.EXPAND["mulaw"].astype(int), m.EXPAND["alaw"].astype(int)
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256


def ima_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(m.IMA_STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(m.IMA_INDEX[code & 7])))
            out.append(value)
    return out


def test_adpcm_across_blocks_is_adpcm_block_by_block():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 64), dtype=np.uint8)
    got = m.ima_blocks(blocks)
    assert [list(map(int, r)) for r in got] == [ima_one(bytes(b)) for b in blocks]


def test_resampling_keeps_a_tone_and_the_length():
    t = np.arange(800) / 8000
    x = (10000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    for rate in (16000, 12000, 6000):
        y = m.resampled(x, 8000, rate)
        want = 10000 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / rate)
        assert len(y) == 800 * rate // 8000
        assert np.abs(y[60:-60] - want[60:-60]).max() < 200


def test_windows_make_the_same_samples():
    x = np.random.default_rng(4).integers(-32768, 32768, 5000).astype(np.int16)
    for rate in (16000, 12000, 6000, 11025):
        whole = m.resampled(x, 8000, rate, window=1 << 30)
        for window in (1, 7, 640, 4096):
            assert (m.resampled(x, 8000, rate, window=window) == whole).all()
    y = x.astype(np.int64)
    expected = f"samples=5000;rms={int(np.sqrt((y * y).sum() / 5000) * 1000) / 1000:.3f};peak={np.abs(y).max()};crossings={((y[1:] < 0) != (y[:-1] < 0)).sum()}"
    before, m.WINDOW = m.WINDOW, 333
    try:
        assert m.measured(x) == expected
    finally:
        m.WINDOW = before
    assert m.measured(x) == expected


def test_a_very_long_text_needs_little_more_than_its_samples():
    x = np.zeros(20_000_000, np.int16)
    tracemalloc.start()
    y = m.resampled(x, 8000, 16000)
    m.measured(y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < y.nbytes + (40 << 20)


def test_query_on_odd_texts(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 50_000, "x" * 64]
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in m.op1_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = m.companded(payload, r.codec)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert got[4][1:] == got[7][1:]
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert m.op1_media_columns(spark, str(tmp_path / "none")).count() == 0


def test_features_come_from_the_resampled_pcm(spark, tmp_path):
    texts = [None, "a", "é" * 32, "x" * 64, "y" * 65, *(f"telephone {i} " * (i + 1) for i in range(12))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    h, codecs = np.sinc(np.arange(-16, 17) / 2) * np.hamming(33), set()
    for r in m.op1_media_columns(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        codecs.add(r.codec)
        x = [v for i in range(0, len(payload), 64) for v in ima_one(payload[i : i + 64])] if r.codec == "ima_adpcm" else [int(m.EXPAND[r.codec][b]) for b in payload]
        y = [sum(x[k] * h[16 + n - 2 * k] for k in range(max(0, (n - 15) // 2), min(len(x), n // 2 + 9)) if 0 <= 16 + n - 2 * k <= 32) for n in range(2 * len(x))]
        y = np.clip(np.rint(np.array(y) + 0.0), -32768, 32767).astype("<i2")
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert int(parts["samples"]) == len(y) and abs(float(parts["rms"]) - np.sqrt((y.astype(float) ** 2).mean())) < 0.01
        assert int(parts["peak"]) == int(np.abs(y.astype(int)).max()) and int(parts["crossings"]) == int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
        assert int(parts["pcm_crc32"]) == zlib.crc32(y.tobytes())
    assert codecs == set(m.CODECS)
