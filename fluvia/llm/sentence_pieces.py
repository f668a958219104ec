"""Encoding and decoding by a merge-type piece vocabulary through a score-ordered agenda.

A text gets a space in front and its spaces become the vocabulary's space symbol. Its symbols are single code points
at first. An agenda (a heap) holds the adjacent pairs whose concatenation is a piece: the highest score comes out first,
of equal ones the leftmost. A pair that comes out is merged in a linked list and its two new neighbours go on the agenda;
entries whose symbols have changed since are passed over. Symbols that are no pieces become the pieces of their bytes.

No merge crosses a place that no piece has inside: where no piece has a space behind another character, and none a
line feed at all, each run of spaces with the word behind it and each line feed are texts of their own. They are learned
once a worker and kept; of a full cache the first ones, mostly the frequent ones, stay. In every Arrow batch, what is
new goes through the sentencepiece library too, and another result than the agenda's is an error.

Defined results: null and empty texts have no ids; a text with the space symbol itself reads as one with a space; texts
of any length are exact, a word of a million characters included (time grows as n log n); repeated rows give equal rows;
an empty table gives an empty table; rows without a doc_id are encoded; other columns aren't read. Ids of bytes that are no
UTF-8 decode to one replacement character a byte, the unknown piece to its surface, control pieces to nothing.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, slices, small_batches

SPACE = "▁"
#: Bytes of text that a task encodes at once.
SLICE_BYTES = 4 << 20
#: Symbols up to which the agendas of many parts advance together as rows of ranks, ROWS at once; longer parts have a heap.
SHORT, ROWS = 48, 8192
#: The rank of pairs that make no piece, and the number of characters that no piece has.
NONE, UNKNOWN_LETTER = 1 << 30, (1 << 20) - 1
#: The pattern of vocabularies that may merge across spaces.
WHOLE = "(?s:.+)"
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """The numbered fields of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")


class Pieces:
    """Pieces, scores and rules of a merge-type model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        specs = {k: dict(_fields(v)) for k, v in parts if k in (2, 3)}
        trained, normal = specs.get(2, {}), specs.get(3, {})
        rows = [dict(_fields(v)) for k, v in parts if k == 1]
        self.pieces = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trained.get(3) != 2 or not trained.get(35) or not {USER_DEFINED, UNUSED}.isdisjoint(kinds):
            raise ValueError("not a merge-type model with byte pieces and without pieces of one's own")
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("not a model that leaves texts as they are, with a space in front")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        score = {p: float(rows[i].get(2, 0.0)) for p, i in self.ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items()}  # the least comes out first
        #: Two characters that no piece has beside each other are never merged.
        self.joined = {p[k : k + 2] for p in (p.replace(SPACE, " ") for p in self.ids) for k in range(len(p) - 1)}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        unknown = trained.get(44, b" \xe2\x81\x87 ")
        self.kinds = np.array(kinds, np.uint8)
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.bytes = [bytes([self.of_byte[i]]) if k == BYTE else b"" if k == CONTROL else unknown if k == UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        self.opens = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, kinds)])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        inside = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p for p in self.ids if p != "\n")
        self.cut = re.compile(WHOLE if inside else " *[^ ]+| +" if lines else " *[^ \n]+| +|\n")

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols that remain when the agenda is empty: a heap of (rank, place), of which an entry counts if the pair
        at its place still has its rank."""
        rank, n = self.rank.get, len(symbols)
        agenda = [(r, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank(a + b)) is not None]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            r, i = heappop(agenda)
            a, j = symbols[i], after[i]
            if not a or j == n or rank(a + symbols[j]) != r:
                continue
            symbols[i] = a = a + symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(a + symbols[k])) is not None:
                    heappush(agenda, (r, i))
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + a)) is not None:
                heappush(agenda, (r, h))
        return [s for s in symbols if s]

    def encoded(self, part: str) -> list[int]:
        """The ids of a part of a text, spaces as they are."""
        out: list[int] = []
        for s in self.merged(list(part.replace(" ", SPACE))):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out += map(self.byte.__getitem__, s.encode())
        return out

    def _pairs(self) -> None:
        """A hash table of pairs of numbered symbols: their rank and the piece that they make."""
        numbers = dict(self.ids)
        for p in self.ids:
            for c in p:
                numbers.setdefault(c, len(self.pieces) + len(numbers))
        self.letters = {ord(c): i for c, i in numbers.items() if len(c) == 1}
        made = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (x := numbers.get(p[:k])) is not None and (y := numbers.get(p[k:])) is not None:
                    made[x << 20 | y] = i
        keys, values = np.fromiter(made.keys(), np.int64, len(made)), np.fromiter(made.values(), np.int32, len(made))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        place = self._place(keys)
        while len(keys):  # one key a free place, the others try the next one
            free = np.flatnonzero(self.keys[place] < 0)
            free = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[free]], self.made[place[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, place = keys[rest], values[rest], (place[rest] + 1) & (len(self.keys) - 1)
        self.ranks = np.array([self.rank.get(p, NONE) for p in self.pieces], np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, -1 where they make none."""
        keys = left << 20 | right
        place = self._place(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            there = self.keys[place[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.made[place[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            place[todo] = (place[todo] + 1) & (len(self.keys) - 1)
        return out

    def _ranked(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.ranks[made], NONE)

    def encoded_all(self, parts: list[str]) -> list[bytes]:
        """``encoded`` of many parts as 32-bit integers. The agendas of short parts of letters that are pieces advance
        together: each step takes the least rank of every part, the leftmost of equal ones, from a row of ranks."""
        out: list[bytes] = [b""] * len(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= SHORT)]
        for a in range(0, len(order), ROWS):
            for k, ids in zip(*self._together([parts[i] for i in order[a : a + ROWS].tolist()], order[a : a + ROWS])):
                out[k] = ids
        return [x or array("i", self.encoded(p)).tobytes() for x, p in zip(out, parts)]

    def _together(self, parts: list[str], at: np.ndarray) -> tuple[list[int], list[bytes]]:
        if not hasattr(self, "keys"):
            self._pairs()
        width = len(parts[-1])
        codes = np.frombuffer("".join(p.ljust(width, "\0") for p in parts).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        inside = (np.arange(width) < np.array([[len(p)] for p in parts])).reshape(-1)
        letters, number = np.unique(codes, return_inverse=True)
        symbols = np.where(inside, np.array([self.letters.get(c, UNKNOWN_LETTER) for c in letters.tolist()], np.int64)[number], -1).reshape(len(parts), width)
        ranks = self._ranked(self.made_of(symbols[:, :-1].reshape(-1), symbols[:, 1:].reshape(-1))).reshape(len(parts), width - 1)
        done: list[int] = []
        found: list[bytes] = []
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(at), np.int64)
            row = np.arange(len(at))
            live = ranks[row, best] < NONE if ranks.shape[1] else np.zeros(len(at), bool)
            ended = symbols[~live]
            known = (ended < len(self.pieces)).all(1)  # others have characters to be written as bytes
            ended, n = ended[known].astype(np.int32), (ended[known] >= 0).sum(1) * 4
            data, end = ended[ended >= 0].tobytes(), np.cumsum(n)
            done += at[~live][known].tolist()
            found += [data[x:y] for x, y in zip((end - n).tolist(), end.tolist())]
            if not live.any():
                return done, found
            at, symbols, ranks, best = at[live], symbols[live], ranks[live], best[live]
            row = np.arange(len(at))
            new = self.made_of(symbols[row, best], symbols[row, best + 1])
            keep = np.arange(symbols.shape[1] - 1)
            keep = keep + (keep > best[:, None])
            symbols = np.take_along_axis(symbols, keep, 1)
            symbols[row, best] = new
            ranks = np.take_along_axis(ranks, keep[:, : ranks.shape[1] - 1], 1) if ranks.shape[1] > 1 else ranks[:, :0]
            for x in (best - 1, best):  # the pairs with the neighbours on both sides
                ok = np.flatnonzero((x >= 0) & (x < ranks.shape[1]))
                ranks[ok, x[ok]] = self._ranked(self.made_of(symbols[ok, x[ok]], symbols[ok, x[ok] + 1]))

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if not len(ids):
            return ""
        size = self.sizes[ids]
        end = np.cumsum(size)
        raw = self.table[np.repeat(self.begin[ids] - (end - size), size) + np.arange(int(end[-1]))].tobytes()
        if not np.isin(self.kinds[ids], (UNKNOWN, CONTROL)).any():
            try:
                return raw[1 if self.opens[ids[0]] else 0 :].decode()
            except UnicodeDecodeError:
                pass
        return self._decoded_stepwise(ids.tolist())

    def _decoded_stepwise(self, ids: list[int]) -> str:
        """With bytes that are no UTF-8, or pieces that aren't normal: the first space goes as long as there is no text."""
        out, run, first = [], bytearray(), True

        def flush() -> None:
            nonlocal first
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            first = first and not run
            run.clear()

        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            flush()
            piece = self.bytes[i].decode()
            if first and self.opens[i]:
                out.append(piece[1:])
                first = False
            else:
                out.append(piece)
                first = first and not piece
        flush()
        return "".join(out)


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Texts to ids with a cache of parts, each checked against the library when it is new."""

    def __init__(self, path: str, most_parts: int = 400_000, kept_parts: int = 100_000):
        import sentencepiece

        self.pieces, self.library = pieces_of(path), sentencepiece.SentencePieceProcessor(model_file=path)
        self.most_parts, self.kept_parts = most_parts, kept_parts
        self.known: dict[str, bytes] = {}
        self.line = len(self.library.encode("\n"))

    def check(self, parts: list[str], found: list[bytes]) -> None:
        """The library's ids of the parts must be the same; it puts a space in front itself, and what has none goes
        behind a line feed. (A space alone isn't checked: it is an empty text to the library.)"""
        spaced = [p.startswith(" ") for p in parts]
        theirs = self.library.encode([p[1:] if s else "\n" + p for p, s in zip(parts, spaced)], num_threads=1)
        for p, s, mine, other in zip(parts, spaced, found, theirs):
            if mine != array("i", other if s else other[self.line :]).tobytes() and p != " ":
                raise ValueError(f"the library has other ids of {p[:80]!r}")

    def learn(self, parts: list[str]) -> None:
        """New parts; one whose last character is never merged with the one before it is a part and that character."""
        known, joined, todo, ends = self.known, self.pieces.joined, {}, []
        for p in parts:
            if len(p) > 1 and p[-2:] not in joined:
                ends.append(p)
                todo.update((x, None) for x in (p[:-1], p[-1]) if x not in known)
            else:
                todo[p] = None
        new = list(todo)
        found = self.pieces.encoded_all(new)
        self.check(new, found)
        known.update(zip(new, found))
        for p in ends:
            known[p] = known[p[:-1]] + known[p[-1]]

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, each a text's piece between two cuts, or several behind each other."""
        known, cut = self.known, self.pieces.cut
        if new := [p for p in parts if p not in known]:
            split = {p: found for p in new if len(found := cut.findall(p)) > 1}
            single = dict.fromkeys(p for p in new if p not in split)
            single.update(dict.fromkeys(q for found in split.values() for q in found if q not in known))
            self.learn(list(single))
            for p, found in split.items():
                known[p] = b"".join(map(known.__getitem__, found))
        return [known[p] for p in parts]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and n + 1 offsets; nulls are empty.

        Arrow splits the texts at their spaces and numbers the parts, so that Python sees each part of a batch once;
        texts with two spaces together, or one at an end, are one part."""
        if len(self.known) > self.most_parts:
            self.known = dict(islice(self.known.items(), self.kept_parts))
        text = pc.replace_substring(column.fill_null("") if column.null_count else column, SPACE, " ")
        odd = pc.or_(pc.match_substring(text, "  "), pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))
        odd = np.flatnonzero(pc.or_(odd, pc.equal(pc.binary_length(text), 0)).to_numpy(zero_copy_only=False) | (self.pieces.cut.pattern == WHOLE))
        parts = pc.split_pattern(text, " ")
        numbered = parts.flatten().dictionary_encode()
        code, at = numbered.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        n_parts = np.diff(at)
        alone = np.ones(len(code), bool)
        for i in odd.tolist():
            alone[at[i] : at[i + 1]] = False
        used = np.zeros(len(numbered.dictionary), bool)
        used[code[alone]] = True
        data = [b""] * len(used)
        places = np.flatnonzero(used)
        for k, ids in zip(places.tolist(), self._known([" " + p for p in numbered.dictionary.take(pa.array(places)).to_pylist()])):
            data[k] = ids
        if len(odd):  # each a text of its own
            data += [b"".join(self._known(self.pieces.cut.findall(" " + t))) if t else b"" for t in text.take(pa.array(odd)).to_pylist()]
            drop = np.ones(len(code), bool)
            drop[~alone] = False
            drop[at[odd]] = True
            code = code.astype(np.int64)
            code[at[odd]] = len(used) + np.arange(len(odd))
            n_parts[odd] = 1
            code = code[drop]
        size, pool = np.fromiter(map(len, data), np.int64, len(data)) // 4, np.frombuffer(b"".join(data), np.int32)
        begin, n = np.cumsum(size) - size, size[code]
        end = np.concatenate(([0], np.cumsum(n)))
        return pool[np.repeat(begin[code] - end[:-1], n) + np.arange(end[-1])], end[np.concatenate(([0], np.cumsum(n_parts)))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            ids, at = e.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (an array) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, path=path or piece_file()), "doc_id long, ids array<int>")


def _ids_of(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    rows = batch.column(column)
    flat, at = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield flat[a:b]


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    p = pieces_of(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decoded(x) for x in _ids_of(batch, 1)], pa.string())], names=["doc_id", "text"])


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of rows (doc_id, ids); rows without ids have an empty text."""
    small_batches(rows.sparkSession)
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return rows.select("doc_id", ids).mapInArrow(partial(_decode, path=path or piece_file()), "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    p = pieces_of(path)
    names = [str(i) for i in range(len(p.pieces))]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = [(len(x), sha(",".join(map(names.__getitem__, x.tolist()))), sha(p.decoded(x))) for x in _ids_of(batch, 1)]
        columns = [*zip(*rows)] or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string())))], names=[x.split()[0] for x in DIGEST.split(", ")])


def op13_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = piece_file()
    return encoded(documents(spark, sf_dir), path).mapInArrow(partial(_digest, path=path), DIGEST)
