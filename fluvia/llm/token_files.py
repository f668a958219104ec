"""Token ids in files of independently reset, checksummed blocks, by an adaptive context-mixing range coder.

Each block starts with an empty model. For every id, two tables predict it from the last two ids (order 2) and from the
last one (order 1), each with a confidence; three odds say which prediction holds, mixed from the counts under the
order-2 and the order-1 confidence. The third, that neither holds, is shared out among all ids by order 0. So an id
takes one step of the range coder, whose range has 60 bits; digits have 20.

Order 0 knows ids by their rank: a group of blocks begins with its ids in the order of their counts. The most frequent
ranks are classes of their own, the others share classes that widen with the rank. Each block counts its classes anew,
beginning from the shares that the group's head states, so a block needs the head of its group and no other block.

All blocks of a group advance together, one id at a time, so that a step is some numpy calls over thousands of blocks.
Divisions are made in double precision, rounded so that both sides get the same integers on every machine.

A file holds a run of documents in ascending doc_id: blocks with sizes and checksums in groups, and a table of the
documents and of the groups' sizes, by which readers take one group at a time. Files are named by the task attempt
that wrote them; the manifest knows only those of attempts that ended.

Defined results: null and empty texts are the end id alone; long texts span blocks; rows that repeat a doc_id are
written each, one behind the other in the order of their texts' hashes; rows without a doc_id come first; an empty
table gives no files and an empty table; other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm.common import BATCH_BYTES, documents, scratch, slices, small_batches, written
from fluvia.llm.word_tokens import word_file, word_tokenizer

MAGIC = b"CMX3"
BLOCK_IDS = 2048
GROUP_BLOCKS = 4096
#: Bytes of text that a file holds, about; there are as many files as shuffle partitions at least.
FILE_BYTES = 256 << 20
FIRST_BITS, SECOND_BITS = 10, 11
#: Ranks that are classes of their own, classes of each further width, bits of the widest.
OWN, EACH, CLASS_BITS = 128, 16, 10
#: Steps between two looks at the class counts, what a count grows by, what the stated shares weigh at first, and the
#: bits of the classes' common total.
REBUILD, CLASS_STEP, STATED, TOTAL_BITS = 128, 4, 2048, 12
DIGIT_BITS, RANGE_BITS = 20, 60
#: The decoder looks up every so many-th slot (a power of two) and goes on from there.
SKIP_BITS = 2
_SIZE = (2 << TOTAL_BITS) - 1
_DIGIT, _LEAST = (1 << DIGIT_BITS) - 1, 1 << (RANGE_BITS - DIGIT_BITS)
#: Three counts in one number: order 2 holds, order 1 holds, all.
_FIELD = 20
_MASK = (1 << _FIELD) - 1
_HIT_TWO, _HIT_ONE, _MISS = 1 | 1 << 2 * _FIELD, 1 << _FIELD | 1 << 2 * _FIELD, 1 << 2 * _FIELD
#: An odds unit is shared out among so many parts, for the classes and the ids in a class.
_SHARE = TOTAL_BITS + CLASS_BITS
_DOWN, _UP = 2.0**-_SHARE * (1 - 2.0**-44), 1 + 2.0**-44


class Ranks:
    """The ids of a group by rank, the classes of ranks, and the counts that the classes begin with."""

    def __init__(self, ids: np.ndarray, stated: np.ndarray):
        self.ids, self.stated = ids, stated
        n, bits, at = max(1, len(ids)), [], 0
        while at < n:
            bits.append(0 if len(bits) < OWN else min(CLASS_BITS, 1 + (len(bits) - OWN) // EACH))
            at += 1 << bits[-1]
        width = 1 << np.array(bits)
        self.first, self.share = np.cumsum(width) - width, (1 << CLASS_BITS) // width
        self.class_of = np.repeat(np.arange(len(bits)), width)
        self.share_of = self.share[self.class_of]
        self.before = (np.arange(at) - self.first[self.class_of]) * self.share_of
        if len(bits) >= 1 << TOTAL_BITS:
            raise ValueError("more ids than the classes of a group can hold")

    @cached_property
    def _rank(self) -> np.ndarray:
        rank = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        rank[self.ids] = np.arange(len(self.ids))
        return rank

    @classmethod
    def of(cls, ids: np.ndarray) -> Ranks:
        """Those of a group's ids; equal counts go by id."""
        counts = np.bincount(ids)
        there = np.flatnonzero(counts)
        there = there[np.lexsort((there, -counts[there]))]
        out = cls(there, np.zeros(0, np.int32))
        sums = np.add.reduceat(counts[there], out.first) if len(there) else np.zeros(1, np.int64)
        out.stated = 1 + STATED * sums // max(1, len(ids))
        return out

    def ranked(self, ids: np.ndarray) -> np.ndarray:
        return self._rank[ids]

    def to_bytes(self) -> bytes:
        data = zlib.compress(self.ids.astype("<u4").tobytes() + self.stated.astype("<u2").tobytes(), 6)
        return GROUP.pack(len(self.ids), len(data), zlib.crc32(data)) + data

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Ranks, int]:
        """The ranks at the front of a group, and where its blocks begin."""
        n, size, crc = GROUP.unpack_from(data)
        raw = data[GROUP.size : GROUP.size + size]
        if zlib.crc32(raw) != crc:
            raise ValueError("a damaged group")
        raw = zlib.decompress(raw)
        return cls(np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, "<u2", offset=4 * n).astype(np.int64)), GROUP.size + size


def _place(placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where classes begin among the shares, and how many slots they have."""
    placed = placed.astype(np.int64)
    return placed >> TOTAL_BITS + 1 << CLASS_BITS, placed & _SIZE


class Model:
    """The adaptive state of many blocks, the same for coder and decoder. A table's entry is the id and two bits of
    confidence; arrays of two rows hold what belongs to order 1 and to order 2."""

    def __init__(self, n: int, ranks: Ranks):
        lane = np.arange(n, dtype=np.int64)
        self.n_classes = n_classes = len(ranks.first)
        self.lane_context = np.stack((lane << FIRST_BITS, (n << FIRST_BITS) + (lane << SECOND_BITS)))
        self.lane_odds, self.lane_class, self.lane_slot = np.stack((lane << 2, n + lane << 2)), lane * n_classes, lane << TOTAL_BITS - SKIP_BITS
        # written at once, so that numpy asks for large memory pages, which zeros() does not get
        self.table = np.full((n << FIRST_BITS) + (n << SECOND_BITS), 0, np.int32)
        self.all_odds = np.full(8 * n, 1 | 1 << _FIELD | 3 << 2 * _FIELD)
        self.counts = np.tile(ranks.stated.astype(np.int32), (n, 1))

    def rebuild(self, n: int, slots: bool) -> None:
        """Class frequencies of the common total, each at least one, from the counts; ``slots``: and their inverse,
        the class of every slot that SKIP_BITS divide."""
        total, few = 1 << TOTAL_BITS, 256  # lanes at a time, whose arrays stay in the processor's cache
        self.placed = np.empty((n, self.n_classes), np.int32)
        slot, each = np.arange(self.n_classes, dtype=np.uint16), total >> SKIP_BITS
        self.slot = np.empty(n * each if slots else 0, np.uint16)
        for lane in range(0, n, few):
            c = self.counts[lane : min(lane + few, n)]
            # quotients of integers this small never round up to the next one
            f = 1 + (c * float(total - self.n_classes) / c.sum(1, keepdims=True)).astype(np.int32)
            f[np.arange(len(f)), c.argmax(1)] += total - f.sum(1, dtype=np.int32)
            end = np.cumsum(f, axis=1, dtype=np.int32)
            self.placed[lane : lane + few] = end - f << TOTAL_BITS + 1 | f
            if slots:
                end += (1 << SKIP_BITS) - 1
                end >>= SKIP_BITS
                end[:, 1:] -= end[:, :-1].copy()
                self.slot[lane * each : (lane + few) * each] = np.repeat(np.tile(slot, len(f)), end.ravel())
        self.placed = self.placed.ravel()

    def find(self, n: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes of lanes that hold a slot, and their places."""
        k = self.lane_class[:n] + self.slot[self.lane_slot[:n] + (slot >> SKIP_BITS)]
        found = self.placed[k]
        later = np.flatnonzero((found >> TOTAL_BITS + 1) + (found & _SIZE) <= slot)
        while len(later):
            k[later] = more = k[later] + 1
            found[later] = v = self.placed[more]
            later = later[(v >> TOTAL_BITS + 1) + (v & _SIZE) <= slot[later]]
        return k, *_place(found)

    def count(self, classes: np.ndarray) -> None:
        """Classes of lanes that ids had; those behind the last lane's are dropped."""
        n = self.counts.size
        self.counts += CLASS_STEP * np.bincount(classes.ravel(), minlength=n + 1)[:n].astype(np.int32).reshape(self.counts.shape)

    def contexts(self, n: int, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.empty((*last.shape[:-1], 2, n), np.int64)
        at[..., 0, :] = (last * 0x9E37 >> 3) & ((1 << FIRST_BITS) - 1)
        at[..., 1, :] = ((last * 0x9E3779B1 + before * 0x85EBCA6B) >> 9) & ((1 << SECOND_BITS) - 1)
        at += self.lane_context[:, :n]
        return at

    def odds(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed counts: order 2 holds, either holds, all."""
        self.at, self.seen = at, self.table[at]
        self.sure = self.seen & 3
        self.by = self.lane_odds[:, :n] + self.sure
        self.had = self.all_odds[self.by]
        mixed = self.had[0] + self.had[1]
        two = mixed & _MASK
        return two, two + (mixed >> _FIELD & _MASK), mixed >> 2 * _FIELD

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """hit: whose entry has the id."""
        two, one = hit[1].astype(np.int64), (hit[0] > hit[1]).astype(np.int64)
        self.all_odds[self.by] = self.had + ((one << _FIELD) + two + _MISS)
        step = (hit & (self.sure < 3)).view(np.int8) - (~hit).view(np.int8)
        self.table[self.at] = np.where(hit | (self.sure > 1), self.seen + step, ids << 2)  # a sure prediction survives one miss


def _live(sizes: np.ndarray) -> np.ndarray:
    """How many of the blocks, longest first, hold an id at each step."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")


def encode_blocks(blocks: list[np.ndarray], ranks: Ranks) -> list[bytes]:
    """The bytes of blocks of ids that have ranks."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    n, steps = len(blocks), int(sizes[0])
    ids = np.zeros((n, steps), np.int32)
    ids[np.arange(steps) < sizes[:, None]] = ranks.ranked(np.concatenate([blocks[i] for i in order]))
    ids = np.ascontiguousarray(ids.T)
    model, live = Model(n, ranks), _live(sizes)
    low, reach = np.zeros(n, np.int64), np.full(n, (1 << RANGE_BITS) - 1)
    lanes: list[np.ndarray] = []  # of the digits in the order in which they come
    digits: list[np.ndarray] = []
    lane = np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int32)
    last = before = np.zeros(n, np.int64)
    for first in range(0, steps, REBUILD):
        n = int(live[first])
        model.rebuild(n, False)
        now = ids[first : first + REBUILD, :n].astype(np.int64)
        history = np.vstack((before[None, :n], last[None, :n], now))
        before, last = history[-2:]
        at = model.contexts(n, history[1:-1], history[:-2])
        classes = ranks.class_of[now] + model.lane_class[:n]
        begins_0, sizes_0 = _place(model.placed[classes])
        begins_0 += ranks.before[now] * sizes_0
        sizes_0 *= ranks.share_of[now]
        for t in range(len(now)):
            n = int(live[first + t])
            x = ids[first + t, :n]
            two, either, every = model.odds(n, at[t, :, :n])
            hit = model.seen >> 2 == x
            unit = (reach[:n] / every * _DOWN).astype(np.int64)
            rest, hits = every - either, np.flatnonzero(hit[0] | hit[1])
            begin, size = (either << _SHARE) + rest * begins_0[t, :n], rest * sizes_0[t, :n]
            if len(hits):
                second, a, b = hit[1][hits], two[hits] << _SHARE, either[hits] << _SHARE
                begin[hits], size[hits] = np.where(second, 0, a), np.where(second, a, b - a)
            begin *= unit
            size *= unit
            l, r = low[:n], reach[:n]
            l += begin
            r[:] = size
            small = np.flatnonzero(size < _LEAST)
            while len(small):
                out = l[small]
                lanes.append(lane[small])
                digits.append((out >> RANGE_BITS - DIGIT_BITS).astype(np.uint32))  # a carry is the digit's 21st bit
                l[small] = (out & _LEAST - 1) << DIGIT_BITS
                wide = r[small] << DIGIT_BITS
                r[small] = wide
                small = small[wide < _LEAST]
            classes[t, n:] = model.counts.size
            classes[t, hits] = model.counts.size
            model.learn(x, hit)
        model.count(classes)
    lanes += 3 * [lane]
    digits += [(low >> shift & (_DIGIT << 1 | 1 if shift == 2 * DIGIT_BITS else _DIGIT)).astype(np.uint32) for shift in (2 * DIGIT_BITS, DIGIT_BITS, 0)]
    of = np.concatenate(lanes)
    order_of = np.argsort(of, kind="stable")
    at = np.bincount(of, minlength=len(lane))
    out = np.zeros((len(lane), int(at.max()) + 1 & ~1), np.uint32)
    out[np.arange(out.shape[1]) < at[:, None]] = np.concatenate(digits)[order_of]
    while (over := out >> DIGIT_BITS).any():
        out &= _DIGIT
        out[:, :-1] += over[:, 1:]
    pairs = (out[:, 0::2].astype("<u8") | out[:, 1::2].astype("<u8") << np.uint64(DIGIT_BITS)).view(np.uint8).reshape(len(lane), -1, 8)
    result = [b""] * len(blocks)
    for k, i in enumerate(order):
        result[i] = pairs[k, : (at[k] + 1) // 2, :5].tobytes()
    return result


def decode_blocks(data: list[bytes], sizes: list[int], ranks: Ranks) -> list[np.ndarray]:
    order = sorted(range(len(data)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order])
    n, steps = len(data), int(size[0])
    width = max(map(len, data)) // 5 + 4
    raw = np.zeros((n, width, 8), np.uint8)
    for k, i in enumerate(order):
        raw[k, : len(data[i]) // 5, :5] = np.frombuffer(data[i], np.uint8).reshape(-1, 5)
    pairs = raw.view("<i8")[:, :, 0]
    digits = np.stack((pairs & _DIGIT, pairs >> DIGIT_BITS), -1).astype(np.uint32).reshape(-1)
    at = np.arange(n) * 2 * width
    off = np.zeros(n, np.int64)  # how far the code lies above low
    for k in range(3):
        off = off << DIGIT_BITS | digits[at + k]
    at += 3
    model, live, reach = Model(n, ranks), _live(size), np.full(n, (1 << RANGE_BITS) - 1)
    ids, classes = np.zeros((steps, n), np.int32), np.empty((REBUILD, n), np.int64)
    last = before = np.zeros(n, np.int64)
    for t in range(steps):
        n = int(live[t])
        if t % REBUILD == 0:
            if t:
                model.count(classes)
            model.rebuild(n, True)
            classes.fill(model.counts.size)
        two, either, every = model.odds(n, model.contexts(n, last[:n], before[:n]))
        unit = (reach[:n] / every * _DOWN).astype(np.int64)
        w = off[:n]
        end_two, end_one = (two << _SHARE) * unit, (either << _SHARE) * unit
        hits = np.flatnonzero(w < end_one)
        share = (every - either) * unit
        place = w - end_one
        x = (place / share * _UP).astype(np.int64)
        x -= x * share > place
        x[hits] = 0
        k, begin, wide = model.find(n, x >> CLASS_BITS)
        c = k - model.lane_class[:n]
        wide *= ranks.share[c]
        in_class = ((x - begin) / wide).astype(np.int32)
        now = ranks.first[c].astype(np.int32) + in_class
        r = share * wide
        l = place - share * (begin + in_class * wide)
        if len(hits):
            under, a, b = w[hits], end_two[hits], end_one[hits]
            second = under < a
            now[hits] = np.where(second, model.seen[1][hits], model.seen[0][hits]) >> 2
            l[hits], r[hits] = under - np.where(second, 0, a), np.where(second, a, b - a)
            k[hits] = model.counts.size
        small = np.flatnonzero(r < _LEAST)
        while len(small):
            next_digit = at[small]
            l[small] = l[small] << DIGIT_BITS | digits[next_digit]
            at[small] = next_digit + 1
            wide = r[small] << DIGIT_BITS
            r[small] = wide
            small = small[wide < _LEAST]
        off[:n], reach[:n] = l, r
        classes[t % REBUILD, :n] = k
        model.learn(now, model.seen >> 2 == now)
        ids[t, :n] = now
        last, before = now.astype(np.int64), last
    ids = ranks.ids.astype("<u4")[np.ascontiguousarray(ids.T)]
    result: list[np.ndarray] = [None] * len(data)
    for k, i in enumerate(order):
        result[i] = ids[k, : sizes[i]]
    return result


HEAD = struct.Struct("<IIII")  # ids, bytes, crc32 of the bytes, crc32 of the ids
GROUP = struct.Struct("<III")  # ids by rank, bytes and crc32 of what states them and their classes
TAIL = struct.Struct("<QQQQ4s")  # documents, groups, where their tables begin and their crc32, MAGIC


def group_bytes(ids: np.ndarray) -> bytes:
    ranks = Ranks.of(ids)
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    return ranks.to_bytes() + b"".join(HEAD.pack(len(block), len(data), zlib.crc32(data), zlib.crc32(block.astype("<u4").tobytes())) + data for block, data in zip(blocks, encode_blocks(blocks, ranks)))


def group_ids(data: bytes) -> Iterator[np.ndarray]:
    """The blocks of a group, checked."""
    ranks, at = Ranks.from_bytes(data)
    heads, parts = [], []
    while at < len(data):
        heads.append(HEAD.unpack_from(data, at))
        parts.append(data[at + HEAD.size : at + HEAD.size + heads[-1][1]])
        at += HEAD.size + heads[-1][1]
    if any(zlib.crc32(p) != h[2] for h, p in zip(heads, parts)):
        raise ValueError("a damaged block")
    for h, ids in zip(heads, decode_blocks(parts, [h[0] for h in heads], ranks)):
        if zlib.crc32(ids.tobytes()) != h[3]:
            raise ValueError("a block that decodes to other ids")
        yield ids


class Writer:
    """A token file that grows by whole groups of blocks."""

    def __init__(self, f):
        self.f, self.docs, self.groups = f, [], []
        self.held, self.n_held, self.whole = [], 0, BLOCK_IDS * GROUP_BLOCKS

    def add(self, doc_ids: list[int | None], ids: np.ndarray, at: np.ndarray) -> None:
        """Documents whose ids lie behind each other, and their n + 1 offsets."""
        self.docs += [(i is not None, i or 0, n) for i, n in zip(doc_ids, np.diff(at).tolist())]
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.whole:
            self._flush(self.n_held // self.whole * self.whole)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.held)
        for at in range(0, n, self.whole):
            data = group_bytes(every[at : min(at + self.whole, n)])
            self.f.write(data)
            self.groups.append(len(data))
        self.held, self.n_held = [every[n:].copy()], len(every) - n

    def end(self) -> int:
        """Bytes of the file."""
        if self.n_held:
            self._flush(self.n_held)
        at = sum(self.groups)
        tables = zlib.compress(np.array(self.docs, "<i8").T.tobytes() + np.array(self.groups, "<i8").tobytes(), 1)
        tail = tables + TAIL.pack(len(self.docs), len(self.groups), at, zlib.crc32(tables), MAGIC)
        self.f.write(tail)
        return at + len(tail)


class Reader:
    """A token file of which one group is held at a time."""

    def __init__(self, f, size: int):
        self.f = f
        n_docs, n_groups, at, crc, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        tables = f.read_at(size - TAIL.size - at, at)
        if magic != MAGIC or zlib.crc32(tables) != crc:
            raise ValueError("not a token file")
        raw = np.frombuffer(zlib.decompress(tables), "<i8")
        named, self.doc_ids, self.sizes = raw[: 3 * n_docs].reshape(3, n_docs)
        self.nameless, self.groups = named == 0, raw[3 * n_docs :]

    def blocks(self) -> Iterator[np.ndarray]:
        at = 0
        for size in self.groups.tolist():
            yield from group_ids(self.f.read_at(size, at))
            at += size


MANIFEST = "file string, named boolean, first_doc long, first_hash long, n_docs long, n_tokens long, n_bytes long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    tokenizer = word_tokenizer(path)
    name, first, out = f"{uuid.uuid4().hex}.cmx", None, None
    for batch in chain.from_iterable(slices(b, 1, BATCH_BYTES) for b in batches):
        ids = batch.column(0).to_pylist()
        if out is None:
            first = (ids[0] is not None, ids[0] or 0, batch.column(2)[0].as_py())
            out = Writer(store.open_output_stream(f"{root}/{name}", compression=None))
        out.add(ids, *tokenizer.encoded(batch.column(1)))
    if out is not None:
        size = out.end()
        out.f.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, *first, len(out.docs), sum(n for *_, n in out.docs), size)], names=[x.split()[0] for x in MANIFEST.split(", ")])


def write_files(docs: DataFrame, path: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """The manifest of the files, a row for each, and their folder. Documents go to files by ranges of doc_id, of which
    there are so many that a file holds about ``file_bytes`` of text."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "token-files")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // file_bytes)
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    dealt = hashed.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    return written(dealt.mapInArrow(partial(_write, folder=folder, path=path or word_file()), MANIFEST), "token-manifest"), folder


OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(reader: Reader) -> Iterator[int]:
    """The crc32 of each document's ids, in order; of a document no more than a block is held."""
    left, crc, k = 0, 0, -1
    sizes = reader.sizes.tolist()
    for ids in reader.blocks():
        data = memoryview(ids).cast("B")
        at = 0
        while at < len(data):
            if not left:
                k += 1
                left, crc = 4 * sizes[k], 0
            end = min(len(data), at + left)
            crc = zlib.crc32(data[at:end], crc)
            left -= end - at
            at = end
            if not left:
                yield crc
    if left or k + 1 != len(sizes):
        raise ValueError("a token file doesn't hold what it lists")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
            with store.open_input_file(f"{root}/{name}") as f:
                reader = Reader(f, size)
                crc = np.fromiter(_documents(reader), np.int64, len(reader.sizes))
            starts = begin + np.cumsum(reader.sizes) - reader.sizes
            yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, mask=reader.nameless), pa.array(starts), pa.array(reader.sizes), pa.array(crc)], names=[x.split()[0] for x in OUT.split(", ")])


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' bytes."""
    ahead = Window.orderBy("named", "first_doc", "first_hash", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("begin"), "n_bytes")
    n = max(1, manifest.count())
    return placed.repartitionByRange(n, "begin").mapInArrow(partial(_read, folder=folder), OUT)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = write_files(documents(spark, sf_dir))
    return read_documents(manifest, folder)
