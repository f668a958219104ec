"""Spelling variants: words one edit apart, through forward and reversed sorted dictionaries.

Of two words one edit apart, the longer of n code points, an edit at or behind position h = n div 2 leaves the first h code
points of both alike, an edit before it the last h. So each word is filed in a forward dictionary under its first h and in a
reversed one under its last h code points, for the two h at which it may be the longer or the shorter one. The dictionaries
are dealt by ranges of their keys and sorted; a task scans the blocks of equal keys and verifies neighbours at growing
distances: words are one edit apart where their common prefix and suffix cover all but one code point of the longer.

A block beyond BLOCK_WORDS is divided: without the shared half, its words are one edit apart in what remains, so the rule
applies to the remainders again, until no block is beyond the bound (remainders of one code point, which can't be divided,
are no more than the letters).
A pair is looked at under the h of its longer word, and in the reversed dictionary only if the forward one hasn't it. A word's form is its most frequent near word if that is frequent enough; forms are followed by doubling.

Defined results: null and empty texts have no words; rows without a doc_id count as those of an id of no characters; rows
that repeat a doc_id count each; near words of equal counts go by code points; long texts are read in bounded parts, words
of any length are exact; without words, or documents, there are no rows; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, small_batches, strings, written

#: Code points of a word, and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: So many times the occurrences of a word has its form.
FORM_RATIO = 5
#: One in so many runs of a text loses a code point.
TYPO_EVERY = 199
#: Words of a block that are verified against each other; larger blocks are divided.
BLOCK_WORDS = 400
#: Rows of a dictionary that a task verifies at once, and the longest words that it compares as rows of a matrix.
SCAN_ROWS, SCAN_LENGTH = 50_000, 48
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Rows of the tables of large blocks and of forms that are broadcast at most.
BROADCAST_ROWS = 200_000
PART_CHARACTERS = 1 << 20
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_BREAK = re.compile("[^a-zÀ-ÿ]")


def runs_of(text: str) -> Iterator[list[str]]:
    """The runs of letters that may be words, A-Z as a-z, in parts of bounded size."""
    text, at = text.encode().lower().decode(), 0  # bytes lower A-Z alone
    while at < len(text):
        end = _BREAK.search(text, at + PART_CHARACTERS)
        end = end.start() if end else len(text)
        yield _RUNS.findall(text, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    crc = zlib.crc32
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
            seed = crc(b":" if doc_id is None else f"{doc_id}:".encode())
            for runs in runs_of(text):
                for run, n in Counter(runs).items():
                    h = crc(run.encode(), seed)
                    if h % TYPO_EVERY == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                    counts[run] += n
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()


def frequent_words(docs: DataFrame) -> DataFrame:
    """word and n, written: the words of docs (doc_id, text) that are long and frequent enough."""
    small_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "frequent-words")


FILED = "block string, side string, h int, rest string, word string, n long"


def filed(rows: DataFrame) -> DataFrame:
    """FILED of rows (block, rest, word, n): each under the first and last h code points of its rest."""
    size = F.length("rest")
    h = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size + 1) / 2).cast("int")))
    out = rows.select("*", F.explode(h).alias("h"))
    out = out.select("*", F.explode(F.when(F.col("h") > 0, F.array(F.lit("f"), F.lit("r"))).otherwise(F.array(F.lit("f")))).alias("side"))
    half = F.when(F.col("side") == "f", F.substring("rest", F.lit(1), F.col("h"))).otherwise(F.reverse(F.right("rest", F.col("h"))))
    return out.select(F.concat("block", F.lit("|"), "side", "h", F.lit(":"), half).alias("block"), "side", "h", "rest", "word", "n")


def remainders(rows: DataFrame) -> DataFrame:
    """(block, rest, word, n) of FILED rows, without the half that the block shares."""
    left = F.length("rest") - F.col("h")
    rest = F.when(F.col("side") == "f", F.right("rest", left)).otherwise(F.left("rest", left))
    return rows.select("block", rest.alias("rest"), "word", "n")


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """The FILED rows of all blocks, those beyond ``most`` words divided."""
    rows, out = written(filed(words.select(F.lit("").alias("block"), F.col("word").alias("rest"), "word", "n")), "dictionary"), None
    while True:
        large = written(rows.groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.max(F.length("rest") - F.col("h")).alias("size")).filter((F.col("words") > most) & (F.col("size") > 1)).select("block"), "large-blocks")
        n = large.count()
        key = F.broadcast(large) if n <= BROADCAST_ROWS else large
        small = rows.join(key, "block", "left_anti") if n else rows
        out = small if out is None else out.unionByName(small)
        if not n:
            return out
        rows = written(filed(remainders(rows.join(key, "block", "left_semi"))), "dictionary")


def one_edit(a: str, b: str) -> bool:
    """Whether two different texts are one edit apart."""
    n, s = max(len(a), len(b)), min(len(a), len(b))
    if n - s > 1:
        return False
    k = next((i for i in range(s) if a[i] != b[i]), s)
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else max(a, b, key=len)[k + 1 :] == min(a, b, key=len)[k:]


def _near(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """Places of the rows (block, side, h, rest) that are one edit apart, whole blocks in a row."""
    n = len(rows)
    names = np.unique([r[0] for r in rows], return_inverse=True)[1]
    reverse, h = np.array([r[1] == "r" for r in rows]), np.array([r[2] for r in rows])
    rests = [r[3] for r in rows]
    size = np.array([len(x) for x in rests])
    short = size <= SCAN_LENGTH
    width = int(size[short].max(initial=0))
    cells = np.frombuffer(b"".join(x.encode("latin-1").ljust(width, b"\0") if s else b"\0" * width for x, s in zip(rests, short)), np.uint8).reshape(n, width)
    backward = np.frombuffer(b"".join(x.encode("latin-1")[::-1].ljust(width, b"\1") if s else b"\0" * width for x, s in zip(rests, short)), np.uint8).reshape(n, width)
    left: list[int] = []
    right: list[int] = []
    first = np.arange(n)
    for d in range(1, n):
        first = first[first < n - d]
        first = first[names[first] == names[first + d]]
        if not len(first):
            break
        second = first + d
        longer = np.maximum(size[first], size[second])
        fits = (longer // 2 == h[first]) & (np.abs(size[first] - size[second]) <= 1)
        a, b, longer = first[fits], second[fits], longer[fits]
        whole = short[a] & short[b]
        for i, j in zip(a[~whole].tolist(), b[~whole].tolist()):
            if one_edit(rests[i], rests[j]) and not (reverse[i] and rests[i][: h[i]] == rests[j][: h[j]]):
                left.append(i)
                right.append(j)
        a, b, longer = a[whole], b[whole], longer[whole]
        least = np.minimum(size[a], size[b])
        same = lambda m: np.minimum(np.where((x := m[a] != m[b]).any(1), x.argmax(1), width), least)  # noqa: B023, E731
        prefix = same(cells)
        ok = (prefix + same(backward) >= longer - 1) & ~(reverse[a] & (prefix >= h[a]))
        left += a[ok].tolist()
        right += b[ok].tolist()
    return left, right


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verified pairs of sorted FILED rows, each in both directions."""

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        a, b = _near(rows)
        a, b = a + b, b + a
        columns = [pa.array([rows[i][4] for i in a], pa.string()), pa.array([rows[i][4] for i in b], pa.string()), pa.array([rows[i][5] for i in b], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) > SCAN_ROWS:
            last = len(held)
            while last and held[last - 1][0] == held[-1][0]:
                last -= 1
            if last:
                yield pairs(held[:last])
                held = held[last:]
    if held:
        yield pairs(held)


def near_words(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word, n) that are one edit apart, each once: of divided blocks
    several may hold one."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks(words, most).repartitionByRange(n, "block").sortWithinPartitions("block", "word")
    return rows.mapInArrow(_scan, "word string, near string, near_n long").distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form from each word of forms (word, form) on. Forms are more frequent, so there is no circle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        other = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = at.join(F.broadcast(other) if at.count() <= BROADCAST_ROWS else other, "root", "left")
        step = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).collect():
            return at


def variants(docs: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs (doc_id, text)."""
    words = frequent_words(docs)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    out = words.join(near, "word", "left").withColumn("found", F.col("best.near_n") >= FORM_RATIO * F.col("n"))
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("found"), F.col("best.near")).alias("form"), F.when(F.col("found"), F.col("best.near_n")).alias("form_n")), "forms")
    roots = with_roots(out.filter("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


_UTF8 = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END))"
SQL = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, length(run) AS size, xor(list_reduce(list_prepend(4294967295, {_UTF8}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, tab),
changed AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(run, 1, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {FORM_RATIO} * w.n THEN near END AS form, CASE WHEN top >= {FORM_RATIO} * w.n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.root WHERE r.form IS NULL"""
