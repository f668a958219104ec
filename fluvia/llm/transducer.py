"""BPE through a minimal acyclic transducer lexicon.

The frequent pre-tokens of the corpus are compiled, with their ids as outputs, into a minimal acyclic automaton with
shared suffixes (built word by word in sorted order). Its arrays lie in one file in the shared folder, which the
tasks map into memory; a word outside the lexicon is merged exactly by the ranks of the vocabulary. Outputs are
perfect hashes: each edge carries the number of words that sort before its subtree's siblings, so the sum along a path is the
word's number, and a number points at the word's ids.

Defined results: null and empty texts have no ids; special tokens written in a text are their own ids; every other
text is exact whatever its length; repeated rows give equal rows; an empty table gives an empty table; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import byte_letters, documents, scratch, small_batches, strings, written

#: Words that the lexicon holds at most: the most frequent of all documents.
LEXICON_WORDS = 100_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Counts from here on are one class where the least count of the lexicon is sought.
HIGHEST_COUNT = 10_000
# Fixed value: the splitting pattern of the byte-level tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
MAGIC = b"MAT1"


def byte_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = {c: b for b, c in byte_letters().items()}, spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = model["vocab"]
        as_bytes = lambda t: bytes(letters[c] for c in t)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.singles = [0] * 256
        n = max(max(vocab.values()), *self.special.values()) + 1
        self.bytes: list[bytes] = [b""] * n
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes[i] = as_bytes(t)
                if len(self.bytes[i]) == 1:
                    self.singles[self.bytes[i][0]] = i
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged, the leftmost first, until none is left.

        Long words keep their pairs in a heap over a linked list, so the time grows as n log n.
        """
        ids = [self.singles[b] for b in word]
        if len(ids) > 64:
            return self._merged_long(ids)
        get, none = self.merges.get, (1 << 60, -1)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        import heapq

        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = to, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, live in zip(ids, alive) if live]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(text: str, marks) -> Iterator[tuple[bool, str]]:
    """The parts of a text between its special tokens, and those."""
    at = 0
    if marks is not None:
        for m in marks.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
    if at < len(text):
        yield False, text[at:]


def compiled(words: dict[bytes, list[int]]) -> bytes:
    """The file of the minimal acyclic transducer that accepts the words and gives their ids."""
    order = sorted(words)
    nodes: list[tuple[bool, dict[int, int]]] = []  # frozen: (final, edges by byte)
    register: dict[tuple, int] = {}
    path: list[tuple[bool, dict[int, int]]] = [(False, {})]

    def freeze(node: tuple[bool, dict[int, int]]) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(node)
        return register[key]

    last = b""
    for word in order:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for k in range(len(last), common, -1):
            path[k - 1][1][last[k - 1]] = freeze(path.pop())
        path += [(False, {}) for _ in word[common:]]
        path[-1] = (True, path[-1][1])
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1][last[k - 1]] = freeze(path.pop())
    root = freeze(path[0])

    below = np.zeros(len(nodes), np.int64)  # words that a node accepts; children are frozen before their parents
    first, labels, targets, numbers = [0], [], [], []
    for i, (final, edges) in enumerate(nodes):
        n = int(final)
        for b in sorted(edges):
            labels.append(b)
            targets.append(edges[b])
            numbers.append(n)
            n += int(below[edges[b]])
        below[i] = n
        first.append(len(labels))
    outputs = [words[w] for w in order]
    arrays = [np.array(x, np.int32) for x in (first, labels, targets, numbers, [final for final, _ in nodes], np.cumsum([0, *map(len, outputs)]), [i for ids in outputs for i in ids])]
    head = MAGIC + struct.pack("<II", root, len(arrays)) + b"".join(struct.pack("<I", len(a)) for a in arrays)
    body = b"".join(a.tobytes() for a in arrays)
    return head + struct.pack("<I", zlib.crc32(body)) + body


class Transducer:
    """A compiled lexicon over a buffer, such as a mapped file."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a transducer")
        self.root, n = struct.unpack_from("<II", view, 4)
        sizes = struct.unpack_from(f"<{n}I", view, 12)
        at = 12 + 4 * n
        if zlib.crc32(view[at + 4 :]) != struct.unpack_from("<I", view, at)[0]:
            raise ValueError("a damaged transducer")
        at += 4
        arrays = []
        for size in sizes:
            arrays.append(np.frombuffer(view, np.int32, size, at))
            at += 4 * size
        self.first, self.labels, self.targets, self.numbers, self.final, self.begin, self.ids = arrays
        #: Edges are sorted by node and label, so one sorted key finds an edge.
        self.edges = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) << 8 | self.labels

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None where the lexicon hasn't it; all words walk the automaton together, byte by byte."""
        n = len(words)
        if not n or not len(self.edges):
            return [self.ids[:0].tolist() if not w and self.final[self.root] else None for w in words]
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        raw = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live, depth = np.flatnonzero(size > 0), 0
        while len(live):
            key = state[live] << 8 | raw[begin[live] + depth]
            e = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[e] == key
            state[live[~hit]] = -1
            live, e = live[hit], e[hit]
            number[live] += self.numbers[e]
            state[live] = self.targets[e]
            depth += 1
            live = live[size[live] > depth]
        found = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        begin, ids = self.begin, self.ids
        return [ids[begin[k] : begin[k + 1]].tolist() if ok else None for ok, k in zip(found.tolist(), number.tolist())]


def mapped(uri: str) -> Transducer:
    """The lexicon in a file; a local or mounted one is mapped, not read."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if isinstance(store, fs.LocalFileSystem):
        return Transducer(pa.memory_map(path).read_buffer())
    with store.open_input_file(path) as f:
        return Transducer(f.read())


class Encoder:
    """Texts to ids: new words go through the lexicon together, and what it hasn't is merged."""

    def __init__(self, path: str, uri: str, most_words: int = 250_000):
        self.vocabulary, self.lexicon, self.most_words = vocabulary(path), mapped(uri), most_words
        self.known: dict[str, tuple[int, str]] = {}
        table = self.vocabulary.bytes
        self.sizes = np.array([len(b) for b in table], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.table = np.frombuffer(b"".join(table), np.uint8)

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        for w, b, ids in zip(words, raw, self.lexicon.lookup(raw)):
            self.known[w] = ",".join(map(str, self.vocabulary.merged(b) if ids is None else ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        known, v = self.known, self.vocabulary
        if len(known) > self.most_words:
            known.clear()
        split = []
        for text in texts:
            parts = []
            for is_mark, part in pieces(text, v.marks if "<" in text else None):
                parts += [(part,)] if is_mark else _SPLIT.findall(part)
            split.append(parts)
        here = dict.fromkeys(chain.from_iterable(split))  # small, so it stays in the processor's cache
        new = []
        for w in here:
            if type(w) is tuple:
                here[w] = str(v.special[w[0]])
            elif (ids := known.get(w)) is None:
                new.append(w)
            else:
                here[w] = ids
        if new:
            self.learn(new)
            for w in new:
                here[w] = known[w]
        return [",".join(map(here.__getitem__, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids behind each other."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.table[np.repeat(self.begin[ids] - (end - size), size) + np.arange(total)].tobytes()


@lru_cache(2)
def encoder(path: str, uri: str) -> Encoder:
    return Encoder(path, uri)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    marks, counts = vocabulary(path).marks, Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in strings(batch.column(0)):
            for is_mark, part in pieces(text, marks if "<" in text else None):
                if not is_mark:
                    counts.update(_SPLIT.findall(part))
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> list[str]:
    """The words seen most often in all documents, ``most`` at most: those of the least count that don't all fit are left
    out; of more than that many words that all reach HIGHEST_COUNT, the most frequent, ties by word."""
    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(partial(_count, path=path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted.filter((F.length("word") <= 64) & (F.col("n") > 1)), "word-counts")
    # how many words have each count, up to a bound, tells the least count whose words all fit
    sizes = counted.groupBy(F.least("n", F.lit(HIGHEST_COUNT)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    if sizes and sizes[0].n == HIGHEST_COUNT and sizes[0].words > most:
        return [r.word for r in counted.filter(F.col("n") >= HIGHEST_COUNT).orderBy(F.desc("n"), "word").limit(most).select("word").collect()]
    least, room = None, most
    for r in sizes:
        if r.words > room:
            break
        least, room = r.n, room - r.words
    return [] if least is None else [r.word for r in counted.filter(F.col("n") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str | None = None, most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of docs; the file's place in the shared folder."""
    path = path or byte_file()
    v = vocabulary(path)
    data = compiled({(b := w.encode()): v.merged(b) for w in frequent_words(docs, path, most)})
    uri = f"{scratch(docs.sparkSession, 'lexicon')}.mat"
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(data)
    return uri


def _encode(batches: Iterator[pa.RecordBatch], path: str, uri: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path, uri)
    for batch in batches:
        texts, out = strings(batch.column(1)), []
        for i in range(0, len(texts), 100):
            out += e.encode(texts[i : i + 100])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "ids"])


def encoded(docs: DataFrame, uri: str, path: str | None = None) -> DataFrame:
    """doc_id and ids: decimal, joined by commas."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, path=path or byte_file(), uri=uri), "doc_id long, ids string")


def _digest(batches: Iterator[pa.RecordBatch], path: str, uri: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path, uri)
    for batch in batches:
        rows = []
        for ids in batch.column(1).to_pylist():
            a = np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)
            text = e.decode(a).decode("utf-8", "replace")
            rows.append((len(a), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        columns = [*zip(*rows)] or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), byte_file()
    uri = build_lexicon(docs, path)
    return encoded(docs, uri, path).mapInArrow(partial(_digest, path=path, uri=uri), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
