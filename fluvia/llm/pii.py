"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table by exact gradients (forward-backward), its weights go to
the tasks, which decode by Viterbi in numpy batches. Words whose shape alone forces the tag "other" cut a text into short runs; the cut is exact, since no
transition can outweigh their margin, so only runs around digits, ``@``, ``=`` or ``+`` are decoded. What a shape can't
tell is checked on the span itself (``plausible``): a learned card has no letters and passes Luhn, for instance.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; base spans always stay
and a learned span that touches one is dropped; ties in start go by kind; repeated rows get equal rows; an empty table
gives an empty table; long texts are decoded whole, shorter ones some at a time; other columns aren't read by the query
and pass through ``redacted`` untouched.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, small_batches, strings, text_bytes, words_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Rows of a labelled table that the field is trained from, at most.
LABELLED_ROWS = 10_000
TAGS = ("other", *KINDS)
Span = tuple[int, int, int]  # start, kind number, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that don't overlap, sorted; a match that fails its check isn't tried again."""
    out: list[Span] = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# Word shapes: a code of 12 bits for each word that has a digit, "@", "=" or "+"; all others have the code PLAIN.
PLAIN = 4095
_STIRS = np.zeros(256, bool)
_STIRS[[*range(48, 58), ord("@"), ord("="), ord("+")]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def shape_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits 0-2: digits (0, 1-3, 4, 5-9, 10-13, 14-19, more); 3-4: dots; 5-6: letters; 7: @; 8: =; 9: + first; 10: bracket; 11: hyphen."""
    codes = np.full(len(starts), PLAIN, np.int64)
    if not len(starts):
        return codes
    stirs = np.concatenate(([0], np.cumsum(_STIRS[raw])))
    at = np.flatnonzero(stirs[ends] > stirs[starts])
    if not len(at):
        return codes
    s, size = starts[at], ends[at] - starts[at]
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    b = raw[np.repeat(s - begin, size) + np.arange(int(size.sum()))]
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), begin)
    digits = np.searchsorted([1, 4, 5, 10, 14, 20], count(_DIGIT[b]), side="right")
    dots, letters = np.minimum(count(b == 46), 3), np.searchsorted([1, 4, 12], count(_LETTER[b]), side="right")
    bits = [(count(b == 64) > 0), (count(b == 61) > 0), b[begin] == 43, count((b == 40) | (b == 41)) > 0, count(b == 45) > 0]
    codes[at] = digits | dots << 3 | letters << 5 | sum(x.astype(np.int64) << (7 + i) for i, x in enumerate(bits))
    return np.minimum(codes, PLAIN)


def _fields(code: np.ndarray) -> list[np.ndarray]:
    return [code & 7, code >> 3 & 3, code >> 5 & 3, code >> 7 & 1, code >> 8 & 1, code >> 9 & 1, code >> 10 & 1, code >> 11 & 1]


@lru_cache(1)
def features() -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 row of features for each code, and the coarse class of each code that its neighbours see."""
    code = np.arange(PLAIN + 1)
    digits, dots, letters, at, eq, plus, bracket, hyphen = _fields(code)
    one_hot = lambda x, n: x[:, None] == np.arange(n)
    parts = [np.ones((len(code), 1)), one_hot(digits * 4 + letters, 32), one_hot(digits * 4 + dots, 32), one_hot(at * 4 + dots, 8), one_hot(eq * 8 + digits, 16), one_hot(plus * 2 + bracket, 4), one_hot(hyphen * 8 + digits, 16)]
    table = np.hstack([p.astype(np.float64) for p in parts])
    table[PLAIN] = 0
    table = np.hstack([table, (code == PLAIN)[:, None].astype(np.float64)])
    coarse = np.select([code == PLAIN, at == 1, eq == 1, plus == 1, bracket == 1, digits >= 3, digits > 0], np.arange(7), 7)
    return table, coarse


EDGE = 8  # the class of what lies outside a text
N_CLASSES = 9


class Field:
    """Weights: own features, the classes of the neighbours, transitions."""

    def __init__(self, weights: np.ndarray):
        table, self.coarse = features()
        self.weights = weights
        k, f = len(TAGS), table.shape[1]
        own, before, after, self.moves = np.split(weights, np.cumsum([f * k, N_CLASSES * k, N_CLASSES * k]))
        self.before, self.after, self.moves = before.reshape(N_CLASSES, k), after.reshape(N_CLASSES, k), self.moves.reshape(k, k)
        self.own = table @ own.reshape(f, k)

    @cached_property
    def forced(self) -> np.ndarray:
        """By code and neighbours' classes: the tag is "other" on every best path, as any other tag's score falls short
        by more than its two transitions can make up for, whatever the tags beside it."""
        lead = lambda x: x[:, :1] - x
        moves = (self.moves[:, :1] - self.moves).min(0) + (self.moves[:1] - self.moves).min(1)
        own, before, after = lead(self.own), lead(self.before), lead(self.after)
        out = np.ones((len(own), N_CLASSES, N_CLASSES), bool)
        for k in range(1, len(TAGS)):
            out &= own[:, None, None, k] + before[None, :, None, k] + after[None, None, :, k] + np.minimum(moves[k], 0) > 1e-6
        return out

    def scores(self, codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.own[codes] + self.before[before] + self.after[after]

    def neighbours(self, codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.coarse[codes]
        before, after = np.full(len(c), EDGE), np.full(len(c), EDGE)
        same = texts[1:] == texts[:-1]
        before[1:][same] = c[:-1][same]
        after[:-1][same] = c[1:][same]
        return before, after

    def decode(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The best tag of each word; all runs between forced words advance together, a step of Viterbi at a time."""
        tags = np.zeros(len(codes), np.int64)
        before, after = self.neighbours(codes, texts)
        at = np.flatnonzero(~self.forced[codes, before, after])
        if not len(at):
            return tags
        emit = self.scores(codes[at], before[at], after[at])
        first = np.concatenate(([True], (np.diff(at) > 1) | (texts[at][1:] != texts[at][:-1])))
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        # a run follows a forced word of its text, or begins the text; so it ends
        led = (at[begin] > 0) & (texts[at[begin]] == texts[np.maximum(at[begin] - 1, 0)])
        last = at[begin + size - 1]
        trailed = (last + 1 < len(codes)) & (texts[last] == texts[np.minimum(last + 1, len(codes) - 1)])
        score = emit[begin] + np.where(led[:, None], self.moves[0], 0)
        back = np.zeros(emit.shape, np.int8)
        final = np.empty((len(begin), len(TAGS)))
        n = len(begin)
        for step in range(1, int(size[0]) + 1):
            going = int(np.searchsorted(-size, -step, side="left"))  # runs longer than this
            final[going:n] = score[going:n]
            n = going
            if not n:
                break
            reach = score[:n, :, None] + self.moves
            rows = begin[:n] + step
            back[rows] = reach.argmax(1)
            score = reach.max(1) + emit[rows]
        final += np.where(trailed[:, None], self.moves[:, 0], 0)
        tag = final.argmax(1)
        for step in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -step, side="left"))
            rows = begin[:n] + step
            tags[at[rows]] = tag[:n]
            tag[:n] = back[rows, tag[:n]] if step else tag[:n]
        return tags


def made_table(n: int = 720, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """A small labelled table for want of a written one: short texts with marked spans, from patterns and a seed."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(a, b)))

    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"+1 {a}.{b}.{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"])

    def card() -> str:
        body = digits(rng.choice([15, 15, 15, 14, 12]))
        number = body + next(d for d in "0123456789" if luhn(body + d))
        return rng.choice(["", "-", " ", "."]).join(number[i : i + 4] for i in range(0, len(number), 4))

    makers = {
        0: lambda: f"{letters(3, 8)}{rng.choice(['.', '_', '', '-'])}{digits(rng.randint(0, 2))}@{letters(4, 8)}{rng.choice(['', '1', '7'])}.{rng.choice(['example.com', 'org', 'net', 'co.uk'])}",
        1: lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        2: card,
        3: phone,
        4: lambda: rng.choice(["password", "token", "api_key", "secret", "passwd"]) + "=" + hexes(rng.randint(12, 32)),
    }
    plain = [
        lambda: digits(rng.randint(1, 4)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 31)}-{rng.randint(1, 12)}-{rng.randint(1950, 2030)}", lambda: f"({digits(2)})",
        lambda: f"{letters(1, 3)}{digits(rng.randint(1, 4))}", lambda: f"{rng.randint(1, 9)},{digits(3)}", lambda: f"{letters(3, 6)}={letters(2, 6)}", lambda: f"{rng.randint(1, 9)}+{rng.randint(1, 9)}",
        lambda: digits(rng.randint(5, 9)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: "1234567890123", lambda: f"@{letters(3, 7)}", lambda: f"{digits(4)}-{digits(4)}", lambda: "=" * rng.randint(1, 5), lambda: "+", lambda: f"x={rng.randint(0, 99)}",
        lambda: hexes(rng.choice([32, 40, 64])), lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: digits(rng.randint(20, 30)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        lambda: f"https://{letters(4, 9)}.org/{letters(2, 5)}?{letters(2, 4)}={digits(rng.randint(1, 6))}", lambda: f"{digits(3)}.{digits(rng.randint(2, 6))}", lambda: f"${rng.randint(1, 9)},{digits(3)}.{digits(2)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}-{letters(2, 4)}{rng.randint(1, 9)}",
    ]
    out = []
    for i in range(n):
        words, spans, at = [], [], 0
        for k in range(rng.randint(4, 14)):
            draw = rng.random()
            if draw < 0.12 and i % 3:
                kind = rng.randrange(5)
                w = makers[kind]()
                spans.append((at, kind, at + len(w)))
                w += rng.choice(["", "", ",", "."])
            elif draw < 0.3:
                w = rng.choice(plain)() + rng.choice(["", "", ",", "."])
            else:
                w = letters(1, 10) + rng.choice(["", "", "", ",", "."])
            words.append(w)
            at += len(w) + 1
        out.append((" ".join(words), spans))
    return out


def tagged(table: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, text numbers and tags of the words of a labelled table of ASCII texts."""
    raw, at = text_bytes(pa.array([t for t, _ in table], pa.string()))
    starts, ends, texts = words_of(raw, at)
    tags = np.zeros(len(starts), np.int64)
    for i, (_, spans) in enumerate(table):
        for a, k, b in spans:
            tags[(texts == i) & (starts < at[i] + b) & (ends > at[i] + a)] = k + 1
    return shape_codes(raw, starts, ends), texts, tags


def train(table: list[tuple[str, list[Span]]], steps: int = 120, penalty: float = 2e-4, rate: float = 0.15) -> Field:
    """Maximum likelihood by Adam on the exact gradient; all texts go through forward-backward together."""
    codes, texts, tags = tagged(table)
    rows, _ = features()
    k, n = len(TAGS), int(texts.max()) + 1
    size = np.bincount(texts, minlength=n)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    width = int(size.max())
    where = begin[:, None] + np.minimum(np.arange(width), np.maximum(size - 1, 0)[:, None])
    mask = np.arange(width) < size[:, None]
    weights = np.zeros(k * (rows.shape[1] + 2 * N_CLASSES + k))
    before, after = Field(weights).neighbours(codes, texts)
    hot = lambda x, m: (x[:, None] == np.arange(m)).astype(np.float64)
    own, bef, aft, gold = rows[codes], hot(before, N_CLASSES), hot(after, N_CLASSES), hot(tags, k)
    inner = np.flatnonzero(texts[1:] == texts[:-1])
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (tags[inner], tags[inner + 1]), 1)
    m1 = m2 = np.zeros_like(weights)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        f = Field(weights)
        emit = f.scores(codes, before, after)[where]
        forth, back = np.empty((n, width, k)), np.zeros((n, width, k))
        forth[:, 0] = emit[:, 0]
        for t in range(1, width):
            forth[:, t] = np.where(mask[:, t, None], log_sum(forth[:, t - 1, :, None] + f.moves, 1) + emit[:, t], forth[:, t - 1])
        for t in range(width - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], log_sum(f.moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(forth[:, -1], 1)
        p = np.exp(forth + back - total[:, None, None])[mask]
        moves = np.zeros((k, k))
        for t in range(1, width):
            live = mask[:, t]
            moves += np.exp(forth[live, t - 1, :, None] + f.moves + (emit[live, t] + back[live, t])[:, None, :] - total[live, None, None]).sum(0)
        d = gold - p
        grad = np.concatenate([(own.T @ d).ravel(), (bef.T @ d).ravel(), (aft.T @ d).ravel(), (seen_moves - moves).ravel()]) / n - penalty * weights
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        weights = weights + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Field(weights)


LABELLED = "text string, spans array<struct<start: int, kind: string, end: int>>"


def labelled_rows(table: DataFrame) -> list[tuple[str, list[Span]]]:
    """The rows of a labelled table (LABELLED) that the field is trained from: LABELLED_ROWS at most, those with the
    smallest hashes. Spans are in code points of ASCII texts; nulls and spans of other kinds don't count."""
    some = table.filter(F.col("text").isNotNull()).select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(LABELLED_ROWS).collect()
    return [(r.text, sorted((s.start, KINDS.index(s.kind), s.end) for s in r.spans or () if s is not None and s.kind in KINDS)) for r in some if r.text.isascii()]


@lru_cache(1)
def default_weights() -> np.ndarray:
    return train(made_table()).weights


def weights_of(labelled: DataFrame | None) -> np.ndarray:
    """The field's weights, trained once, on the driver; tasks get these few thousand numbers and train nothing."""
    rows = None if labelled is None else labelled_rows(labelled)
    return default_weights() if not rows else train(rows).weights


_EDGES = ".,;:!?()[]{}\"'|#*<>`~"
_FOUR_PARTS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]{1,5})?")


def plausible(kind: int, piece: str) -> bool:
    """What a learned span must be beside its shape."""
    name, digits = KINDS[kind], _NOT_DIGIT.sub("", piece)
    if name == "email":
        local, _, domain = piece.partition("@")
        return bool(local) and "." in domain.strip(".")
    if name == "ip":
        return _FOUR_PARTS.fullmatch(piece) is not None and all(int(x) < 256 for x in re.split("[:/]", piece)[0].split("."))
    if name == "secret":
        key, _, value = piece.partition("=")
        return any(c.isalpha() for c in key) and len(value.strip("=\"'")) >= 8
    if any(c.isalpha() for c in piece):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if name == "card" else 10 <= len(digits) <= 15


def find(column: pa.Array, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    raw, at = text_bytes(column)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * (len(at) - 1)
    first = 0
    while first < len(at) - 1:  # some texts at a time bound the memory
        end = max(first + 1, int(np.searchsorted(at, at[first] + (1 << 21), side="right")) - 1)
        part, part_at = raw[at[first] : at[end]], at[first : end + 1] - at[first]
        starts, ends, texts = words_of(part, part_at)
        codes = shape_codes(part, starts, ends)
        stirred = np.unique(texts[codes != PLAIN])
        if len(stirred):
            tags = field.decode(codes, texts)
            marked = np.flatnonzero(tags)
            by_text: dict[int, list[int]] = {}
            for w in marked.tolist():
                by_text.setdefault(int(texts[w]), []).append(w)
            for i in stirred.tolist():
                data = part[part_at[i] : part_at[i + 1]].tobytes()
                text = data.decode()
                base = base_spans(text)
                found = list(base)
                if words := by_text.get(i):
                    found += _learned(data, base, words, tags, starts - part_at[i], ends - part_at[i])
                out[first + i] = (base, sorted(found))
        first = end
    return out


def quality(field: Field, table: list[tuple[str, list[Span]]]) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of the labelled spans of each kind, spans being right if they are so to the letter."""
    got = [set(spans) for _, spans in find(pa.array([t for t, _ in table], pa.string()), field)]
    gold = [set(spans) for _, spans in table]
    out = {}
    for k, kind in enumerate(KINDS):
        found, there = (sum(s[1] == k for spans in side for s in spans) for side in (got, gold))
        right = sum(s[1] == k for x, y in zip(got, gold) for s in x & y)
        out[kind] = (right / found if found else 1.0, right / there if there else 1.0, there)
    return out


#: Words that a card or phone number can have, at most.
NUMBER_WORDS = 6


def _learned(data: bytes, base: list[Span], words: list[int], tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[Span]:
    """The plausible spans of a text's tagged words that touch no base span. From each word on, the longest run of
    neighbours of one tag that is plausible is a span; words of other kinds than card and phone are spans alone."""
    ahead = [x for x, _, _ in base]
    reach = np.maximum.accumulate([y for _, _, y in base]) if base else []
    at = points = i = 0
    while i < len(words):
        kind, j = int(tags[words[i]]) - 1, i
        if KINDS[kind] in ("card", "phone"):
            while j + 1 < len(words) and j + 1 < i + NUMBER_WORDS and words[j + 1] == words[j] + 1 and tags[words[j + 1]] == kind + 1:
                j += 1
        begin = int(starts[words[i]])
        points, at = points + len(data[at:begin].decode()), begin
        while j >= i:
            whole = data[begin : int(ends[words[j]])].decode()
            piece = whole.rstrip(_EDGES)
            a, b = points, points + len(piece)
            if KINDS[kind] != "phone":
                piece = piece.lstrip(_EDGES)
                a = b - len(piece)
            if a < b and plausible(kind, piece):
                near = bisect_left(ahead, b)
                if not near or reach[near - 1] <= a:
                    yield a, kind, b
                break
            j -= 1
        i = max(i, j) + 1


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_learned long"


def _detect(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    field = Field(weights)
    for batch in batches:
        rows = []
        for base, spans in find(batch.column(1), field):
            n = [sum(k == kind for _, k, _ in base) for kind in range(4)] if base else [0] * 4
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        columns = [*zip(*rows)] or [()] * 7
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in OUT.split(", ")])


def detected(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Counts, digest and spans of each row; the field is trained from ``labelled``, or from the made table."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_detect, weights=weights_of(labelled)), OUT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first counts."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(text: Column | str, labelled: DataFrame | None = None) -> Column:
    """The text with its personal data masked; null stays null."""
    weights = weights_of(labelled)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = Field(weights)
        for texts in batches:
            column = pa.array(texts, pa.string())
            found = find(column, field)
            yield pd.Series([t if t is None or not spans else masked(t, spans) for t, (_, spans) in zip(column.to_pylist(), found)], dtype=object)

    return mask(F.col(text) if isinstance(text, str) else text)


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(documents(spark, sf_dir))
