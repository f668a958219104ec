"""MinHash near-duplicates through a multi-index Hamming join.

A document's set holds the hashes of its distinct word shingles. Its signature is 50 symbols of 16 bits, the least
hash under 50 functions each; the share of symbols in which two signatures differ estimates one less their
similarity. The signature is split into 10 chunks of 5 symbols. By the pigeonhole principle two signatures that differ
in at most 19 symbols have a chunk with at most one difference, so every chunk is filed five times, each time with
another symbol left out: each pair within 19 differences meets in a bucket, for certain. (A pair of similarity 0.8
meets with probability 1 - 2e-6, as buckets also hold most pairs beyond 19 differences.)

Rows of equal sets are one class from the start. In a bucket, classes are first compared with its least member only,
each class with one such partner; what is confirmed on the full sets is joined into components. Then the buckets that
still hold several components are searched through in cells of two blocks of bounded size: rows that are within 25
differences of a row of another component get their full sets, and each cell returns the links that join its
components. So no link between different texts is lost, and no group ever becomes a table of its pairs.

Defined results: null texts and texts without a word have an empty set and are linked with nothing, as are rows without
a doc_id, which are kept; a text of fewer words than a shingle is one shingle; repeated rows are one class; an empty table gives an empty table; other columns
pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, mixed, small_batches, text_bytes, word_hashes, words_of, written
from fluvia.llm.components import components

SYMBOLS, CHUNK = 50, 5
#: Signatures that differ in more symbols aren't confirmed; at similarity 0.8 that happens once in 10^6 pairs.
MAX_DIFFERENT = 25
#: Rows of a bucket that are compared with each other at once.
BLOCK_ROWS = 500
#: Pairs of one class that a task confirms at once.
STAR_ROWS = 2000
#: Rows of the table of components that is broadcast, at most (24 bytes each).
BROADCAST_ROWS = 50_000
#: Ids of the documents whose texts are asked for that are broadcast, at most (8 bytes each); beyond, texts are shuffled.
BROADCAST_IDS = 200_000

_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_ORDER = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = text_bytes(column)
    starts, ends, texts = words_of(raw, at)
    words = word_hashes(raw, starts, ends)
    begin = np.searchsorted(texts, np.arange(len(at)))
    for i in range(len(at) - 1):
        w = words[begin[i] : begin[i + 1]]
        n = max(1, len(w) - width + 1)
        if not len(w):
            yield w
            continue
        if len(w) < width:
            h = np.uint64(len(w)) * _ORDER[-1] + (w * _ORDER[: len(w)]).sum(dtype=np.uint64)
            yield mixed(np.array([h], np.uint64))
            continue
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h += w[k : k + n] * _ORDER[k]
        yield np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _A + _B).min(0))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a, b, s = [], [], [], []
        for x in shingle_sets(batch.column(1), width):
            n.append(len(x))
            a.append(x.sum(dtype=np.uint64))
            b.append(mixed(x + np.uint64(1)).sum(dtype=np.uint64))
            s.append(signature(x).tobytes() if len(x) else b"")
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), longs(a), longs(b), pa.array(s, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature 50 keys: of each chunk, the hash of the symbols that remain when one is left out."""
    s = signatures.astype(np.uint64) + np.uint64(1)
    out = np.empty((len(s), SYMBOLS), np.uint64)
    for c in range(SYMBOLS // CHUNK):
        part = s[:, c * CHUNK : (c + 1) * CHUNK] * _ORDER[:CHUNK]
        whole = part.sum(1, dtype=np.uint64)
        for k in range(CHUNK):
            out[:, c * CHUNK + k] = mixed((whole - part[:, k]) * _ORDER[6] + np.uint64(c * CHUNK + k))
    return out


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(s).reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), width)], pa.binary())], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, keep) if k], pa.int64()), pa.array([x for x, k in zip(b, keep) if k], pa.int64())], names=["a", "b"])


def shingle_table(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full sets of the documents whose id is needed; a doc_id that repeats has a row each."""
    needed = written(needed, "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = docs.select("doc_id", "text").join(needed, F.col("doc_id") == F.col("id"), "left_semi")
    return written(texts.mapInArrow(partial(_sets, width=width), "id long, shingles binary"), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough. b's set comes by a join on b; the pairs of one a
    are dealt to several tasks, each of which gets a's set once."""
    sets = shingle_table(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), width)
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("shares"))
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    left = left.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).join(shares, "a").select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return left.join(right, ["a", "share"]).select("a", "b", "set_a", "set_b").mapInArrow(partial(_confirm, percent=percent), "a long, b long").distinct()


def near_in_cell(cell: tuple[int, int, int], blocks: np.ndarray, ids: np.ndarray, parts: np.ndarray, s: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell (key, i, j), each with those rows of another component that are near it.

    Cells with i = j compare a block with itself, others two blocks of a bucket. A pair that meets in several buckets
    counts in the first of its shared keys only.
    """
    key, i, j = cell
    keys = bucket_keys(s).view(np.int64)
    place = (keys == key).argmax(1)
    one, two = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    for r in one:
        other = two[parts[two] != parts[r]]
        if i == j:
            other = other[ids[other] > ids[r]]
        other = other[(s[other] != s[r]).sum(1) <= most]
        other = other[(keys[other] == keys[r]).argmax(1) == place[r]]
        if len(other):
            yield r, other


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are sorted by their first three columns, a group at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:3] != row[:3]:
                yield held[0][:3], held
                held = []
            held.append(row)
    if held:
        yield held[0][:3], held


CELL = "key long, i int, j int, block int, id long, component long, signature binary"


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    return (*(np.array([r[c] for r in rows]) for c in (3, 4, 5)), np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, SYMBOLS))


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each cell the rows that are near a row of another component."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for cell, rows in _groups(batches):
        if len(rows) > 1:
            some: set[int] = set()
            for r, other in near_in_cell(cell, *_arrays(rows), most):
                some |= {int(r), *other.tolist()}
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(rows[r] for r in sorted(some))), kinds)], names=[x.split()[0] for x in CELL.split(", ")])


def _search(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of a cell on the full sets, no more than join its components: a forest, not all pairs."""
    for cell, rows in _groups(batches):
        ids, parts = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(len(names), np.int32)
        root = {int(p): int(p) for p in parts}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for r, other in near_in_cell(cell, *_arrays(rows), most):
            mark[number[begin[r] : begin[r + 1]]] = 1
            for o in other:
                x, y = find(int(parts[r])), find(int(parts[o]))
                if x != y:
                    both = int(mark[number[begin[o] : begin[o + 1]]].sum())
                    if 100 * both >= percent * (size[r] + size[o] - both):
                        root[max(x, y)] = min(x, y)
                        a.append(int(parts[r]))
                        b.append(int(parts[o]))
            mark[number[begin[r] : begin[r + 1]]] = 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = written(docs.select("doc_id", "text").mapInArrow(partial(_sign, width=width), SIGNED), "signatures")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets: a class, known by its least doc_id
    classes = some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"))
    classes = written(classes, "classes")
    filed = written(classes.select("id", "signature").mapInArrow(_file, "key long, id long"), "buckets")
    # buckets of several classes: each class and the least member that it meets anywhere
    shared = filed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") < F.col("most"))
    filed = written(filed.join(shared, "key").select("key", "id", "least"), "shared-buckets")
    stars = written(filed.groupBy("id").agg(F.min("least").alias("a")).filter(F.col("a") < F.col("id")).select("a", F.col("id").alias("b")), "stars")
    found = written(confirmed(stars, docs, width, percent), "links")
    parts = written(components(found), "components")
    # buckets that still hold several components
    n_parts = parts.count()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    labelled = filed.join(small(parts.withColumnRenamed("node", "id"), n_parts), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = written(labelled, "labelled-buckets")
    # a bucket's largest component needs no search within itself: its blocks only meet those of the others, which come first
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    open_ = sizes.agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda c: F.ceil(c / BLOCK_ROWS).cast("int")
    open_ = open_.select("key", F.col("big.component").alias("big"), blocks(F.col("n") - F.col("big.n")).alias("small_blocks"), blocks(F.col("big.n")).alias("big_blocks"))
    in_big, hashed = F.col("component") == F.col("big"), F.xxhash64("id")
    block = F.when(in_big, F.col("small_blocks") + F.pmod(hashed, F.col("big_blocks"))).otherwise(F.pmod(hashed, F.col("small_blocks"))).cast("int")
    rows = labelled.join(open_, "key").withColumn("block", block).join(classes.select("id", "signature"), "id")
    others = F.sequence(F.lit(0), F.col("small_blocks") + F.when(in_big, 0).otherwise(F.col("big_blocks")) - 1)
    cells = rows.withColumn("other", F.explode(others))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "signature")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = written(dealt(cells).mapInArrow(partial(_compare, most=MAX_DIFFERENT), CELL), "near")
    sets = shingle_table(docs, near.select("id").distinct(), width)
    links = dealt(near.join(sets, "id").select(*near.columns, "shingles")).mapInArrow(partial(_search, most=MAX_DIFFERENT, percent=percent), "a long, b long")
    merged = components(links)
    # the component of each class, then of each row
    final = classes.select("id", "set_a", "set_b").join(small(parts.withColumnRenamed("node", "id"), n_parts), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    final = final.join(merged.withColumnRenamed("node", "part"), "part", "left").select("set_a", "set_b", F.coalesce("component", "part").alias("component_id"))
    final = written(final, "class-components")
    linked = some.drop("signature").join(small(final, final.count()), ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)
