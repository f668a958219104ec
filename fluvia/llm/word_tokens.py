"""Token ids of whole texts by a tokenizer file that drops white space, piece by piece with a cache of pieces."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fluvia.llm.common import _LOWER, byte_letters, text_bytes

#: The id behind every document.
END_ID = 2
SEPARATOR = "<|startoftext|>"
#: What a byte is in a word: part of Latin letters, a digit, another sign of ASCII, or one that only the library splits.
WHOLE, LETTER, DIGIT, SIGN = range(4)
_KIND = np.full(256, WHOLE, np.uint8)
_KIND[33:127] = SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[ord("'")] = WHOLE
#: How byte-level vocabularies write bytes, as UTF-32; spaces stay.
_LETTERS = np.array([ord(byte_letters()[b]) if b != ord(" ") else b for b in range(256)], "<u4")


def pieces_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, given by their bytes and n + 1 offsets, in lower case, where their pieces begin, and the pieces' kinds.

    A piece is a run of letters of ASCII and U+00C0 to U+00FF, one digit, or a run of other signs. A word with anything
    else, an apostrophe or what may begin a special token is one piece as it is."""
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)  # not the signs of multiplication and division
    lead, second = lead[letter], second[letter]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead + 1] = np.where(second == 0x9F, second, second | 0x20)
    hard = np.flatnonzero(kind == WHOLE)
    if len(tags := np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))):
        hard = np.concatenate((hard, tags))
    if len(hard):
        word = np.unique(np.searchsorted(at, hard, side="right") - 1)
        n = at[word + 1] - at[word]
        whole = np.repeat(at[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        kind[whole], low[whole] = WHOLE, raw[whole]
    first = np.ones(len(raw), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first[at[at < len(raw)]] = True
    starts = np.flatnonzero(first)
    return low, starts, kind[starts]


def _runs(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of a pool, given by their beginnings and lengths, behind each other."""
    return pool.take(np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()))


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space before it splits, and none of its patterns or normal forms reaches across white
    space, so the ids of a text are those of its words behind each other, and those of a word are those of its pieces.
    Each new piece goes through the library once; of a full cache the pieces that came first, mostly the frequent ones,
    stay.
    """

    def __init__(self, path: str, most_pieces: int = 800_000, kept_pieces: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.separator = self.library.token_to_id(SEPARATOR)
        # the same model without normal forms, for pieces that have theirs
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most_pieces, self.kept_pieces = most_pieces, kept_pieces
        #: Pieces and their numbers in order; their ids lie behind each other in that order.
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole words, and how many each has; words go through the library as one text, parted by a special
        token, those with what may be one by themselves."""
        texts = [w.decode() for w in words]
        ids = np.array(self.library.encode_batch_fast([SEPARATOR.join(x for x in texts if "<|" not in x)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.separator), len(ids)).tolist()
        parts = (ids[a:b] for a, b in zip([0, *(x + 1 for x in ends)], ends))
        found = [np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4") if "<|" in x else next(parts) for x in texts]
        return np.concatenate(found), np.array([*map(len, found)])

    def _encoded_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces in lower case; each ends with an id that ends a word."""
        line = _LETTERS[np.frombuffer(b" ".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _learn(self, pieces: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The numbers of new pieces; whole: which are words that only the library splits."""
        order = np.argsort(whole, kind="stable")
        names, n = pieces[order].tolist(), len(pieces) - int(whole.sum())
        found = [encode(names[i : min(i + 8000, end)]) for at, end, encode in ((0, n, self._encoded_pieces), (n, len(names), self._encoded)) for i in range(at, end, 8000)]
        first = len(self.known)
        self.known.update(zip(names, range(first, first + len(names))))
        self.ids, self.size = np.concatenate((self.ids, *(x for x, _ in found))), np.concatenate((self.size, *(x for _, x in found)))
        if len(self.size) != len(self.known) or len(self.ids) != self.size.sum():
            raise ValueError("a piece without an id that ends a word")
        self.begin = np.cumsum(self.size) - self.size
        numbers = np.empty(len(names), np.int64)
        numbers[order] = np.arange(first, first + len(names))
        return numbers

    def _pooled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words behind each other, and how many each has."""
        raw, at = text_bytes(words)
        low, starts, kind = pieces_of(raw, at)
        offsets = np.append(starts, len(low)).astype(np.int32)
        numbered = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        code, names = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, names.tolist(), repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(number < 0)):
            whole = np.zeros(len(names), bool)
            whole[code] = kind == WHOLE
            number[new] = self._learn(names[new], whole[new])
        piece = number[code]
        n = self.size[piece]
        end = np.concatenate(([0], np.cumsum(n)))
        return _runs(self.ids, self.begin[piece], n), np.diff(end[np.searchsorted(starts, at)])

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with their end ids behind each other, and n + 1 offsets; nulls are empty.

        Arrow splits the texts and numbers their distinct words and these words' distinct pieces, so that Python sees
        each piece of a batch once."""
        if len(self.known) > self.most_pieces:
            n = self.kept_pieces
            self.known = dict(islice(self.known.items(), n))
            self.ids, self.begin, self.size = self.ids[: self.begin[n]].copy(), self.begin[:n].copy(), self.size[:n].copy()
        split = pc.ascii_split_whitespace(column.fill_null("") if column.null_count else column)
        numbered = split.flatten().dictionary_encode()
        pool, size = self._pooled(numbered.dictionary)
        pool, size = np.append(pool, np.uint32(END_ID)), np.append(size, 1)  # the end id is one word more
        at = split.offsets.to_numpy()
        last = at[1:] - at[0] + np.arange(len(at) - 1)
        code, inner = np.full(len(numbered) + len(last), len(size) - 1, np.int32), np.ones(len(numbered) + len(last), bool)
        inner[last] = False
        code[inner] = numbered.indices.to_numpy()
        n = size.take(code)
        return _runs(pool, (np.cumsum(size) - size).take(code), n), np.concatenate(([0], np.cumsum(n)[last]))

    def batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids and the end id."""
        ids, at = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)
