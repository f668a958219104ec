"""Hierarchical multi-length packing of token ids into windows of several context sizes.

Every document is cut into full windows of the longest tier; what remains goes to the tier of the smallest window that
holds it. Tiers are packed from the longest: an item opens a window of its tier, the gap is filled with the largest
shorter items that fit, and at last a further item is cut so that the window is exactly full. So of each group of
documents (a bounded run of a partition) only the last window has padding. Windows of one tier form step groups of
equal token budgets, all full but the last few of a task, which share what is left evenly.

Defined results: a null or empty text is the end id alone; a text longer than any window is cut at window bounds; ties
in length go by row order; repeated rows are packed each; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from fluvia.llm.common import documents, slices, small_batches
from fluvia.llm.word_tokens import word_file, word_tokenizer

WINDOWS = (512, 1024, 2048, 4096)
#: A group of documents is packed when it holds so many ids.
GROUP_TOKENS = 2_000_000
#: Ids of one training step.
STEP_TOKENS = 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long"


def packed(lengths: list[int], windows: tuple[int, ...] = WINDOWS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (window, pieces) of documents with these numbers of ids; a piece is (document, start, length)."""
    longest = windows[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    free: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for doc, n in enumerate(lengths):
        full = n // longest * longest
        out += [(longest, [(doc, at, longest)]) for at in range(0, full, longest)]
        if n > full:
            free.append((n - full, doc, full))
    free.sort()
    while free:
        n, doc, start = free.pop()
        window = windows[bisect_left(windows, n)]
        pieces, gap = [(doc, start, n)], window - n
        while gap and free:
            k = bisect_right(free, (gap, len(lengths), 0)) - 1
            if k >= 0:
                n, doc, start = free.pop(k)
            else:  # every item is longer than the gap: cut the shortest
                n, doc, start = free.pop(0)
                insort(free, (n - gap, doc, start + gap))
                n = gap
            pieces.append((doc, start, n))
            gap -= n
        out.append((window if not gap else longest, pieces))
    return out


class Steps:
    """Deals sequences into step groups of equal budgets: a group is filled by windows of one size, over all groups of
    documents of a task; what is left of the sizes at the end is shared out evenly among as few mixed steps as hold it."""

    def __init__(self, first: int = 0, budget: int = STEP_TOKENS):
        self.next, self.budget = first, budget
        self.open: dict[int, list] = {}  # by size: sequences that wait for their step to be full

    def add(self, window: int, sequence) -> Iterator[tuple[int, object]]:
        """(step, sequence) of the step that this sequence fills, if it does."""
        waiting = self.open.setdefault(window, [])
        waiting.append(sequence)
        if (len(waiting) + 1) * window > self.budget:
            for x in waiting:
                yield self.next, x
            self.next += 1
            waiting.clear()

    def end(self) -> Iterator[tuple[int, object]]:
        """The sequences that still wait, longest windows first, each to the step that holds least."""
        rest = [(w, x) for w in sorted(self.open, reverse=True) for x in self.open[w]]
        n = -(-sum(w for w, _ in rest) // self.budget)
        held = [(0, self.next + k) for k in range(n)]
        for w, x in rest:
            size, step = heappop(held)
            yield step, x
            heappush(held, (size + w, step))
        self.next += n
        self.open.clear()


def _pack(batches: Iterator[pa.RecordBatch], path: str, windows: tuple[int, ...], group_tokens: int) -> Iterator[pa.RecordBatch]:
    tokenizer, task = word_tokenizer(path), TaskContext.get().partitionId() << 33
    held: list[tuple[int, np.ndarray]] = []
    n_held, sequence, dealt = 0, task, Steps(task)

    def batch_of(found: Iterator[tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        if rows := [(*piece, step) for step, pieces in found for piece in pieces]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def flush() -> Iterator[tuple[int, list[tuple]]]:
        nonlocal sequence, n_held
        for window, pieces in packed([len(ids) for _, ids in held], windows):
            offset, rows = 0, []
            for doc, start, length in pieces:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, offset, window))
                offset += length
            sequence += 1
            yield from dealt.add(window, rows)
        held.clear()
        n_held = 0

    for batch in chain.from_iterable(slices(b, 1) for b in batches):
        every, at = tokenizer.encoded(batch.column(1))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            held.append((doc_id, every[a:b]))
            n_held += b - a
            if n_held >= group_tokens:
                yield from batch_of(flush())
    yield from batch_of(chain(flush(), dealt.end()))


def pack(docs: DataFrame, path: str | None = None, windows: tuple[int, ...] = WINDOWS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence. No shuffle: each task packs what it reads."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_pack, path=path or word_file(), windows=windows, group_tokens=group_tokens), SCHEMA)


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
