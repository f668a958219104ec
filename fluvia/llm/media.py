"""Media columns: telephony audio as WAV bytes, its expansion to linear samples, and resampled PCM.

``store`` wraps byte payloads as mu-law, A-law or IMA ADPCM WAV files in a binary column, ``decoded`` reads such a
column back, expands the companded codes by 256-entry tables, decodes ADPCM blocks with numpy across all blocks of an
Arrow batch, and adds the resampled 16-bit PCM as WAV bytes.

Defined results: null and empty texts are one block of 64 zero bytes; long texts are stored whole; equal payloads have
equal media and PCM whatever their row; an empty table gives an empty table; other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fluvia.llm.common import documents, small_batches, strings, written

RATE = 8000
TARGET_RATE = 16000
BLOCK = 64
CODECS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}  # the format tags of WAV

# Fixed values of the IMA ADPCM format: quantiser steps, and the index change by the low three bits of a code.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, size + 8, (size + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": _mulaw(), "alaw": _alaw()}


def wav(tag: int, data: bytes, rate: int, n_samples: int, bits: int = 8, align: int = 1, extra: bytes = b"") -> bytes:
    """A mono WAV file with a format chunk of the tag, a fact chunk and the data."""
    per_second = rate * align if align < BLOCK else rate * align * 8 // (8 * ((align - 4) * 2 + 1))
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n_samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, -1, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def companded(payload: bytes, codec: str) -> bytes:
    """The payload, a multiple of 64 bytes, as a WAV file: codes of 8 bits, or ADPCM blocks of 64 bytes."""
    if codec == "ima_adpcm":
        per_block = (BLOCK - 4) * 2 + 1
        return wav(CODECS[codec], payload, RATE, len(payload) // BLOCK * per_block, bits=4, align=BLOCK, extra=struct.pack("<H", per_block))
    return wav(CODECS[codec], payload, RATE, len(payload))


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks, one row each: every step of the recurrence is taken for all blocks at once."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step, low = IMA_STEPS[index], code & 7
        change = (step >> 3) + step * (low >> 2) + (step >> 1) * (low >> 1 & 1) + (step >> 2) * (low & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[low], 0, len(IMA_STEPS) - 1)
        out[k] = value
    return np.ascontiguousarray(out.T)


def _filter(up: int, taps: int) -> np.ndarray:
    n = np.arange(-taps * up, taps * up + 1)
    return np.sinc(n / up) * np.hamming(len(n))


#: Samples that are resampled, or measured, at once.
WINDOW = 1 << 18


def resampled(samples: np.ndarray, rate: int, target: int, taps: int = 8, window: int = WINDOW) -> np.ndarray:
    """Linear 16-bit samples at another rate: a polyphase filter with a windowed sinc, each phase one convolution.

    Windows of the output are made one after another, each from the samples within the filter's reach, so that no more than
    a window is ever held as floats."""
    g = np.gcd(rate, target)
    up, down = int(target // g), int(rate // g)
    if up == down:
        return samples
    h = _filter(max(up, down), taps) * (up / max(up, down))
    half = len(h) // 2
    n_out = -(-len(samples) * up // down)
    out = np.empty(n_out, np.int16)
    window = max(up, window // up * up)
    for a in range(0, n_out, window):
        b = min(n_out, a + window)
        low, high = max(0, (a * down - half) // up - 1), min(len(samples), ((b - 1) * down + half) // up + 2)
        x, some = samples[low:high].astype(np.float64), np.empty(b - a, np.float64)
        for first in range(min(up, b - a)):
            at = np.arange(a + first, b, up) * down - low * up  # positions on the fine grid; their phase is the same
            phase = (at[0] + half) % up
            y = np.convolve(x, h[phase::up])
            index = (at + half - phase) // up
            some[first::up] = np.where(index < len(y), y[np.minimum(index, len(y) - 1)], 0)
        out[a:b] = np.clip(np.rint(some), -32768, 32767)
    return out


def measured(y: np.ndarray) -> str:
    """Length, root mean square, peak and zero crossings of 16-bit samples, window by window."""
    squares = peak = crossings = 0
    for a in range(0, len(y), WINDOW):
        x = y[a : a + WINDOW + 1].astype(np.int64)  # the next window's first sample counts for the crossing to it
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:WINDOW]
        squares += int((x * x).sum())
        peak = max(peak, int(np.abs(x).max()))
    rms = int(np.sqrt(squares / len(y)) * 1000) / 1000
    return f"samples={len(y)};rms={rms:.3f};peak={peak};crossings={crossings}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = list(CODECS)
    for batch in batches:
        sizes, codecs, media = [], [], []
        for text in strings(batch.column(1)):
            raw = text.encode()
            sizes.append(len(raw))
            payload = raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")
            codecs.append(names[zlib.crc32(payload) % len(names)])
            media.append(companded(payload, codecs[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(codecs, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "codec", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, codec and media (WAV bytes); a payload's checksum picks its codec."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, codec string, media binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags, payloads = [], []
        for media in batch.column("media").to_pylist():
            tag, _, data = unwrap(media)
            tags.append(tag)
            payloads.append(data)
        adpcm = [i for i, t in enumerate(tags) if t == CODECS["ima_adpcm"]]
        linear: list[np.ndarray] = [None] * len(tags)
        if adpcm:
            blocks = np.frombuffer(b"".join(payloads[i] for i in adpcm), np.uint8).reshape(-1, BLOCK)
            samples, at = ima_blocks(blocks), 0
            for i in adpcm:
                n = len(payloads[i]) // BLOCK
                linear[i] = samples[at : at + n].reshape(-1)
                at += n
        for codec in EXPAND:
            for i in (i for i, t in enumerate(tags) if t == CODECS[codec]):
                linear[i] = EXPAND[codec][np.frombuffer(payloads[i], np.uint8)]
        pcm = []
        for x in linear:
            y = resampled(x, RATE, TARGET_RATE)
            pcm.append(wav(1, y.astype("<i2").tobytes(), TARGET_RATE, len(y), bits=16, align=2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(payloads, pa.binary()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "codec", "media", "payload", "pcm"])


def decoded(media: DataFrame) -> DataFrame:
    """The stored media with their payload bytes and their PCM, resampled to 16 kHz, as WAV bytes."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "codec", "media").mapInArrow(_decode, "doc_id long, n_bytes long, codec string, media binary, payload binary, pcm binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, payload, pcm in zip(*(batch.column(c).to_pylist() for c in ("media", "payload", "pcm"))):
            data = unwrap(pcm)[2]
            feature = f"{measured(np.frombuffer(data, '<i2'))};pcm_crc32={zlib.crc32(data)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = [*zip(*rows)] or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(2)], names=names)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store(documents(spark, sf_dir)), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string"
    return decoded(stored).mapInArrow(_digest, schema)
