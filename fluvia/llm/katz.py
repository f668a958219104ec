"""Katz backoff language model of words, trained and evaluated by three exchanges of packed columns.

Texts become chunks: bounded runs of documents with a local vocabulary (64-bit word hashes) and a stream of local
word numbers. Chunks ask for what they need by bucket, and every bucket answers each chunk in the order it asked:

1. words, by hash: training counts and word numbers; out come the unigram table and its counts of counts;
2. pairs of words that both are known, by a hash of the pair: pair counts; out come the bigram table, its counts of
   counts, and for each context the pieces of its sums, wherever its pairs lie, so that no context is one group;
3. contexts, by word: denominators and backoff weights.

A bucket's rows are packed arrays, one row for each chunk, so a frequent word costs a bucket no more than one entry a
chunk. Then P(w2 | w1) = d(c) c / c(w1) for pairs that training saw (d: Good-Turing discounts up to 5), and
otherwise alpha(w1) P(w2), where alpha makes the sum over all words exactly one; P(w) is discounted alike and leaves
the rest to the unknown word. A text starts after an end token.

Defined results: null and empty texts have the end token alone; rows without a doc_id train; without training texts every token is unknown and the
scores are those of the unknown word; repeated rows train and are scored each; an empty table gives an empty table;
other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, mixed, small_batches, text_bytes, word_hashes, words_of, written

#: Counts up to this one are discounted.
K = 5
#: Pairs that training saw less often back off: none that it saw at all.
LEAST_PAIR = 1
CHUNK_BYTES = 10 << 20
BUCKET_BYTES = 4 << 20
BUCKET_TOKENS = 1_000_000
END = np.uint64(0x5EED0FE2D)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes: high bytes are mostly zero."""
    raw = np.ascontiguousarray(a)
    planes = raw.reshape(-1).view(np.uint8).reshape(raw.size, raw.itemsize).T.tobytes()
    return raw.size.to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


CHUNKS = "chunk long, doc_ids binary, held binary, sizes binary, tokens binary, words binary, counts binary, end_at long, n_tokens long, n_words long"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    for number, (ids, raw, at) in enumerate(_gathered(batches), number):
        starts, ends, texts = words_of(raw, at)
        sizes = np.bincount(texts, minlength=len(ids)) + 1
        stop = np.cumsum(sizes)
        stream = np.full(int(stop[-1]), END, np.uint64)
        inner = np.ones(len(stream), bool)
        inner[stop - 1] = False
        stream[inner] = word_hashes(raw, starts, ends)
        words, tokens = np.unique(stream, return_inverse=True)
        held = np.array([held_out(i) for i in ids])
        counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
        kind = held + 2 * np.array([i is None for i in ids])
        row = (number, pack(np.array([i or 0 for i in ids], np.int64)), pack(kind.astype(np.uint8)), pack(sizes.astype(np.int64)), pack(tokens.astype(np.int32)), words.tobytes(), pack(counts.astype(np.int64)), int(np.searchsorted(words, END)), len(stream), len(words))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[x.split()[0] for x in CHUNKS.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Ids and bytes of neighbouring texts, of CHUNK_BYTES at most unless one text alone is longer."""
    ids, parts, sizes, total = [], [], [], 0
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            if ids and total + b - a > CHUNK_BYTES:
                yield ids, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
                ids, parts, sizes, total = [], [], [], 0
            ids.append(doc_id)
            parts.append(raw[a:b])
            sizes.append(b - a)
            total += b - a
    if ids:
        yield ids, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


EXCHANGE = "bucket int, chunk long, kind string, a binary, b binary, c binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * 6, kinds)], names=[x.split()[0] for x in EXCHANGE.split(", ")])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in EXCHANGE.split(", ")])


def parts(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    """For each bucket the positions of its entries, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def word_buckets(words: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes: the buckets of sorted words lie behind each other."""
    return np.minimum(words // np.uint64(((1 << 64) - 1) // n), np.uint64(n - 1)).astype(np.int64)


def _ask_words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts"))):
            words, counts = np.frombuffer(words, np.uint64), unpack(counts, np.int64)
            yield _batch([(b, chunk, "ask", words[p].tobytes(), pack(counts[p]), b"") for b, p in enumerate(parts(word_buckets(words, n), n)) if len(p)])


def counts_of_counts(counts: np.ndarray) -> bytes:
    """Sum, number, and how many counts are 1 .. K + 1, as text."""
    return ",".join(map(str, [int(counts.sum()), len(counts), *(np.count_nonzero(counts == r) for r in range(1, K + 2))])).encode()


def _answer_words(group: pd.DataFrame, n: int) -> pd.DataFrame:
    bucket = int(group.bucket.iloc[0])
    asked = [np.frombuffer(x, np.uint64) for x in group.a]
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unpack(x, np.int64) for x in group.b]), minlength=len(words)).astype(np.int64)
    seen = counts > 0
    number = np.where(seen, np.cumsum(seen) * n - n + bucket + 1, 0)  # 0: not in training
    rows = [(bucket, -1, "stat", counts_of_counts(counts[seen]), b"", b""), (bucket, -1, "unigram", words[seen].tobytes(), pack(counts[seen]), b"")]
    at = 0
    for chunk, x in zip(group.chunk, asked):
        p = place[at : at + len(x)]
        rows.append((bucket, chunk, "word", pack(number[p]), pack(counts[p]), b""))
        at += len(x)
    return _frame(rows)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0 .. K from the numbers of counts 1 .. K + 1; what Good-Turing leaves undefined isn't discounted."""
    d = np.ones(K + 1)
    n1, top = int(n[0]), (K + 1) * int(n[K])
    share = top / n1 if n1 else 1.0
    for r in range(1, K + 1):
        if share < 1 and n[r - 1] and n[r]:
            x = ((r + 1) * int(n[r]) / (r * int(n[r - 1])) - share) / (1 - share)
            if 0 < x <= 1:
                d[r] = x
    return d


class Unigrams:
    """Discounted word probabilities by training count; count 0 is the unknown word."""

    def __init__(self, stat: np.ndarray):
        self.total, self.distinct = int(stat[0]), int(stat[1])
        self.d = discounts(stat[2:])
        left = sum(int(stat[1 + r]) * r * (1 - self.d[r]) for r in range(1, K + 1))
        if left > 0:
            self.scale, self.unknown = self.total, left / self.total
        else:
            self.d, self.scale, self.unknown = np.ones(K + 1), self.total + 1, 1 / (self.total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= K, self.d[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, d * counts / self.scale, self.unknown)


class Chunk:
    """A chunk's arrays and what the buckets answered."""

    def __init__(self, row: dict):
        self.tokens, self.sizes, self.held = unpack(row["tokens"], np.int32).astype(np.int64), unpack(row["sizes"], np.int64), unpack(row["held"], np.uint8)
        self.held, self.nameless = (self.held & 1).astype(bool), self.held > 1
        self.n_words = row["n_words"]
        self.number, self.count = self.joined(row, "word", np.int64, np.int64)
        # each token's context; a text begins after the end token
        end = row["end_at"]
        before = np.concatenate(([end], self.tokens[:-1]))
        stop = np.cumsum(self.sizes)
        before[stop[:-1]] = end
        self.before = before
        known = (self.number[before] > 0) & (self.number[self.tokens] > 0)
        self.known_at = np.flatnonzero(known)
        # pairs in the order of their word numbers, for which the bytes compress well
        order = np.argsort(self.number, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[self.tokens[known]] << 32 | rank[before[known]]
        self.pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.second, self.first = order[self.pairs >> 32], order[self.pairs & 0xFFFFFFFF]
        train = np.repeat(~self.held, self.sizes)[known]
        self.pair_counts = np.bincount(self.pair_of[train], minlength=len(self.pairs))

    def joined(self, row: dict, kind: str, *kinds) -> list[np.ndarray]:
        """The buckets' answers about the chunk's words, in the words' order."""
        answers = sorted((x["bucket"], x["a"], x["b"]) for x in row["answers"] if x["kind"] == kind)
        return [np.concatenate([unpack(x[1 + i], k) for x in answers]) for i, k in enumerate(kinds)]

    def pair_parts(self, n: int) -> list[np.ndarray]:
        h = mixed(self.number[self.first].astype(np.uint64) * _P + self.number[self.second].astype(np.uint64) * _Q)
        return parts((h % np.uint64(n)).astype(np.int64), n)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _two(a: np.ndarray, b: np.ndarray) -> bytes:
    first = pack(a)
    return len(first).to_bytes(4, "little") + first + pack(b)


def _ask_pairs(batches: Iterator[pa.RecordBatch], n_pairs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            c = Chunk(row)
            out = []
            for b, p in enumerate(c.pair_parts(n_pairs)):
                if len(p):
                    one, two = c.number[c.first[p]], c.number[c.second[p]]
                    out.append((b, row["chunk"], "ask", _two(np.diff(two, prepend=0), one), pack(c.pair_counts[p].astype(np.int32)), pack(c.count[c.second[p]].astype(np.int64))))
            yield _batch(out)


def _answer_pairs(group: pd.DataFrame, n: int, unigrams: Unigrams) -> pd.DataFrame:
    bucket = int(group.bucket.iloc[0])
    ones, twos = [], []
    for x in group.a:
        k = int.from_bytes(x[:4], "little")
        twos.append(np.cumsum(unpack(x[4 : 4 + k], np.int64)))
        ones.append(unpack(x[4 + k :], np.int64))
    one, two = np.concatenate(ones), np.concatenate(twos)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    n_pairs = int(new.sum())
    counts = np.bincount(place, weights=np.concatenate([unpack(x, np.int32) for x in group.b]), minlength=n_pairs).astype(np.int64)
    rows, at = [(bucket, -1, "stat", counts_of_counts(counts[counts > 0]), b"", b"")], 0
    kept = counts >= LEAST_PAIR
    for chunk, x in zip(group.chunk, ones):
        p = place[at : at + len(x)]
        rows.append((bucket, chunk, "pair", pack(np.where(kept[p], counts[p], 0)), b"", b""))
        at += len(x)
    first = order[new]
    one, two, second = one[first][kept], two[first][kept], np.concatenate([unpack(x, np.int64) for x in group.c])[first][kept]
    counts = counts[kept]
    rows.append((bucket, -1, "bigram", pack(one), pack(two), pack(counts)))
    if len(one):
        # of each context: how many pairs were seen 1 .. K times, the sum of larger counts, and of the words' own probabilities
        begin = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
        sums = np.column_stack([*(np.add.reduceat((counts == r).astype(float), begin) for r in range(1, K + 1)), np.add.reduceat(np.where(counts > K, counts, 0).astype(float), begin), np.add.reduceat(unigrams.p(second), begin)])
        context = one[begin]
        for b, p in enumerate(parts((context - 1) % n, n)):
            if len(p):
                rows.append((b, -1, "context", pack(context[p]), pack(sums[p]), b""))
    return _frame(rows)


def _answer_contexts(group: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    """Denominators and backoff weights of the words that each chunk asked for."""
    bucket = int(group.bucket.iloc[0])
    given, asked = group[group.kind == "context"], group[group.kind == "word"]
    if len(given):
        context, place = np.unique(np.concatenate([unpack(x, np.int64) for x in given.a]), return_inverse=True)
        values = np.concatenate([unpack(x, np.float64).reshape(-1, K + 2) for x in given.b])
        sums = np.column_stack([np.bincount(place, weights=values[:, j], minlength=len(context)) for j in range(K + 2)])
    else:
        context, sums = np.zeros(0, np.int64), np.zeros((0, K + 2))
    seen = sums[:, :K] @ (d[1:] * np.arange(1, K + 1)) + sums[:, K]
    rows = []
    for chunk, a, b in zip(asked.chunk, asked.a, asked.b):
        number, count = unpack(a, np.int64), unpack(b, np.int64).astype(np.float64)
        at = np.minimum(np.searchsorted(context, number), max(0, len(context) - 1))
        hit = context[at] == number if len(context) else np.zeros(len(number), bool)
        below, weight = count.copy(), np.ones(len(number))
        if hit.any():
            s, rest, c = seen[at[hit]], 1 - sums[at[hit], K + 1], count[hit]
            c = np.where(s > c * (1 - 1e-9), c + 1, c)  # nothing would be left for other words
            c = np.where(rest > 1e-12, c, s)  # or there are none
            below[hit] = c
            weight[hit] = np.where(rest > 1e-12, (1 - s / c) / np.maximum(rest, 1e-300), 0)
        rows.append((bucket, chunk, "weight", pack(below), pack(weight), b""))
    return _frame(rows)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], n_pairs: int, unigrams: Unigrams, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            c = Chunk(row)
            below, weight = c.joined(row, "weight", np.float64, np.float64)
            pair_counts, where = np.zeros(len(c.pairs), np.int64), c.pair_parts(n_pairs)
            for x in row["answers"]:
                if x["kind"] == "pair":
                    pair_counts[where[x["bucket"]]] = unpack(x["a"], np.int64)
            with np.errstate(divide="ignore"):
                own = np.log10(unigrams.p(c.count))
                back = np.log10(weight)
                # the recursion: the pair where training saw it, else the context's weight and the word
                log_p = back[c.before] + own[c.tokens]
                met = pair_counts[c.pair_of] > 0
                r = pair_counts[c.pair_of][met]
                share = np.where(r <= K, d[np.minimum(r, K)], 1.0) * r
                log_p[c.known_at[met]] = np.log10(share / below[c.before[c.known_at[met]]])
            begin = np.concatenate(([0], np.cumsum(c.sizes)[:-1]))
            base = np.log10((c.count + 1) / (unigrams.total + unigrams.distinct + 1))
            columns = [pa.array(unpack(row["doc_ids"], np.int64), mask=c.nameless), c.held, c.sizes, np.add.reduceat((c.count[c.tokens] > 0).astype(np.int64), begin), np.full(len(c.sizes), unigrams.total), np.add.reduceat(base[c.tokens], begin), np.add.reduceat(log_p, begin)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in OUT.split(", ")])


def _stat(table: DataFrame) -> np.ndarray:
    """The sum of the buckets' counts of counts: one row."""
    x = F.split(F.decode("a", "UTF-8"), ",")
    row = table.filter("kind = 'stat'").agg(*[F.sum(F.get(x, F.lit(i)).cast("long")) for i in range(K + 3)]).first()
    return np.array([n or 0 for n in row], np.int64)


def scored(docs: DataFrame) -> DataFrame:
    """Each text's base-10 log probabilities by the add-one unigrams and by the backoff model."""
    spark = docs.sparkSession
    small_batches(spark)
    chunks = written(docs.select("doc_id", "text").mapInArrow(_chunk, CHUNKS), "chunks")
    size = chunks.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    n, n_pairs = 1 + 8 * (size[1] or 0) // BUCKET_BYTES, 1 + (size[0] or 0) // BUCKET_TOKENS
    asked = chunks.select("chunk", "words", "counts").mapInArrow(partial(_ask_words, n=n), EXCHANGE)
    words = written(asked.groupBy("bucket").applyInPandas(partial(_answer_words, n=n), EXCHANGE), "unigrams")
    unigrams = Unigrams(_stat(words))

    def answered(*tables: DataFrame) -> DataFrame:
        every = tables[0]
        for t in tables[1:]:
            every = every.unionByName(t)
        lists = every.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "a", "b")).alias("answers"))
        return chunks.drop("words", "counts").join(lists, "chunk")

    asked = answered(words).mapInArrow(partial(_ask_pairs, n_pairs=n_pairs), EXCHANGE)
    pairs = written(asked.groupBy("bucket").applyInPandas(partial(_answer_pairs, n=n, unigrams=unigrams), EXCHANGE), "bigrams")
    d = discounts(_stat(pairs)[2:])
    both = words.filter("kind = 'word'").unionByName(pairs.filter("kind = 'context'"))
    weights = written(both.groupBy("bucket").applyInPandas(partial(_answer_contexts, d=d), EXCHANGE), "backoff-weights")
    return answered(words, pairs, weights).mapInArrow(partial(_score, n_pairs=n_pairs, unigrams=unigrams, d=d), OUT)


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
