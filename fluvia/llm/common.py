"""What the operators of this subpackage share: table access, scratch tables, numpy text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fluvia.sources.scratch import scratch, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


#: Bytes of an Arrow batch, beyond which it takes no further row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, as texts can be long. The session keeps the bound, which changes no result; its
    number of rows in a batch is left alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts in a column have ``size`` bytes together, or one row that is longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(lengths, dtype=np.int64)
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(end, (end[first - 1] if first else 0) + size, side="right")))
        yield batch.slice(first, last - first)
        first = last


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and n + 1 offsets; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, count=column.offset + n + 1)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, and the text that each belongs to."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, block: int = 1 << 21) -> np.ndarray:
    """64-bit hashes of words (polynomial over their bytes, scrambled), in blocks of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        s, e = starts[i:j], ends[i:j]
        size = e - s
        begin = np.concatenate(([0], np.cumsum(size)))
        total = int(begin[-1])
        pos = np.arange(total) - np.repeat(begin[:-1], size)
        code = raw[np.repeat(s, size) + pos]
        code = (_LOWER[code] if lower else code).astype(np.uint64) + np.uint64(1)
        power = np.full(int(size.max()), _MUL, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        out[i:j] = np.add.reduceat(code * power[pos], begin[:-1])
        i = j
    return mixed(out)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
