"""Ranked lexical search of a set of items in all documents: a threshold-seeded join.

One pass over the texts stores, for each document, its number of terms and the counts of those that an item has. From the
document frequencies comes each term's weight, and from it the impact of each posting: what the term adds to the
document's score. Then, all as joins and windows:

1. Seeds: the k highest impacts of each term are stored with their documents. The documents in the lists of an item's terms
   are scored; the kth highest of these scores is no more than the item's kth score: its threshold.
2. Pruning: an item's terms are ordered by their highest impact. The longest suffix of terms whose highest impacts together
   stay below the threshold can't bring a document to it: a result has one of the other terms, the essential ones.
3. Candidates: documents with essential terms and the sum of these impacts. The kth highest sum raises the threshold, and
   a document stays if its sum and the bound of the suffix reach it.
4. Rescoring: the impacts of the suffix terms are joined to the candidates, the strongest first, until scores are exact;
   after each step the threshold is raised again and candidates that can't reach it go.

Everything is kept that reaches a threshold, so ties at the kth place are settled by doc_id alone. Nothing is
approximate: k, the stored lists and the thresholds change the work, not the result.

Defined results: null texts have no terms, and documents without terms aren't counted; rows that repeat a doc_id are
documents of their own, rows without one rank behind others of the same score; rows that repeat an item_id are one item
with the terms of all, rows without one are left out; items without terms or matches have no rows; long texts are
read in bounded parts; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.llm.common import documents, small_batches, strings, table, written

K = 10
#: Distinct terms of all items that go to every task at most; beyond, terms are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Rows of small tables (weights, terms of items) that are broadcast at most.
BROADCAST_ROWS = 500_000
PART_BYTES = 1 << 20
#: Letters and digits of ASCII and everything beyond it are parts of terms, A-Z as a-z; all else is a space.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def parts_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size."""
    data, at = text.encode().translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + PART_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int] | None) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, the items' terms (all, as words, without numbers) and their counts."""
    kind = pa.string() if numbers is None else pa.int32()
    for batch in batches:
        sizes, terms, counts = [], [], []
        for text in strings(batch.column(1)):
            found, n = Counter(), 0
            for words in parts_of(text):
                n += len(words)
                found.update(words)
            kept = list(found if numbers is None else found.keys() & numbers.keys())
            sizes.append(n)
            terms.append([w.decode() for w in kept] if numbers is None else [numbers[w] for w in kept])
            counts.append([found[w] for w in kept])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(kind)), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
            words = set().union(*parts_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.int64()), pa.array([w.decode() for w in words], pa.string())], names=["item_id", "word"])


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _kth(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, kth): the kth highest value of each key; keys with fewer rows have none."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), "row"))
    return df.withColumn("at", at).filter(F.col("at") <= k).groupBy(key).agg(F.min(value).alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select(key, "kth")


def weight(n_docs: int) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")


def impact(n_docs: int, n_terms: int) -> Column:
    """What a term adds to the score of a document; whole numbers throughout."""
    length = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {n_terms}L)")
    return F.col("w") * F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 8 * length)


def counted(docs: DataFrame, words: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """The written documents (row, doc_id, n, terms, counts) and their postings (row, n, term, tf), of the words (word,
    term) alone."""
    small_batches(docs.sparkSession)
    fits = n_words <= BROADCAST_TERMS
    numbers = {r.word.encode(): r.term for r in words.collect()} if fits else None
    kind = "array<int>" if fits else "array<string>"
    found = docs.select("doc_id", "text").mapInArrow(partial(_count, numbers=numbers), f"doc_id long, n long, terms {kind}, counts array<long>")
    found = written(found.filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "term-counts")
    flat = found.select("row", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", "n", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    return found, flat if fits else flat.withColumnRenamed("term", "word").join(words, "word").drop("word")


def _rescored(some: DataFrame, weak: DataFrame, n_weak: int, postings: DataFrame, k: int) -> DataFrame:
    """Candidates (item_id, row, part) with the impacts of the items' other terms weak (item_id, term, most, suffix) added.

    The strongest of these come first, 2, 4, 8, .. at once; after each step a candidate stays if its sum and the bound of
    the terms still to come reach the kth highest sum of its item. So few candidates meet the many weakest terms."""
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("most"), F.desc("term")))
    weak = written(weak.select("item_id", "term", "suffix", order.alias("place")), "weak-terms")
    last = weak.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    low, step = 0, 2
    while True:
        kth = _kth(some, "item_id", "part", k)
        rest = weak.filter(F.col("place") > low).groupBy("item_id").agg(F.max("suffix").alias("rest"))
        kept = some.join(_small(kth, n_weak), "item_id", "left").join(_small(rest, n_weak), "item_id", "left")
        some = written(kept.filter(F.col("part") + F.coalesce("rest", F.lit(0)) >= F.coalesce("kth", F.lit(0))).select("item_id", "row", "part"), "kept-candidates")
        if low >= last:
            return some
        now = weak.filter((F.col("place") > low) & (F.col("place") <= low + step)).select("item_id", "term")
        asked = some.join(_small(now, n_weak), "item_id")
        there = postings.join(_small(now.select("term").distinct(), n_weak), "term", "left_semi")
        there = there.join(_small(some.select("row").distinct(), some.count()), "row", "left_semi")
        more = there.join(asked.select("item_id", "row", "term"), ["row", "term"]).select("item_id", "row", F.col("impact").alias("part"))
        some = written(some.unionByName(more).groupBy("item_id", "row").agg(F.sum("part").alias("part")), "candidates")
        low, step = low + step, 2 * step


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = items.filter("item_id IS NOT NULL").select("item_id", "text").mapInArrow(_terms, "item_id long, word string").distinct()
    asked = written(asked, "item-words")
    words = asked.select("word").distinct()
    n_words = words.count()
    number = F.row_number().over(Window.orderBy("word")) if n_words <= BROADCAST_TERMS else F.col("word")
    words = written(words.withColumn("term", number), "words")
    found, postings = counted(docs, words, n_words)
    total = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    weights = written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight(total.n).alias("w")).filter("w > 0"), "weights")
    postings = postings.join(_small(weights, n_words), "term").select("term", "row", impact(total.n, total.terms).alias("impact")).filter("impact > 0")
    # the highest impacts of each term, and from them the thresholds: of the documents in an item's lists, the kth score
    at = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    seeds = written(postings.withColumn("at", at).filter(F.col("at") <= k), "seeds")
    wanted = written(asked.join(_small(words, n_words), "word").select("item_id", "term"), "item-terms")
    n_wanted = wanted.count()
    pairs = written(_small(wanted, n_wanted).join(seeds, "term").select("item_id", "row").distinct(), "seeded")
    n_rows = pairs.select("row").distinct().count()
    known = postings.join(_small(pairs.select("row").distinct(), n_rows), "row", "left_semi").join(_small(wanted, n_wanted), "term")
    known = known.join(_small(pairs, pairs.count()), ["item_id", "row"], "left_semi").groupBy("item_id", "row").agg(F.sum("impact").alias("score"))
    bounds = wanted.join(seeds.filter("at = 1").select("term", F.col("impact").alias("most")), "term").join(_kth(known, "item_id", "score", k), "item_id", "left")
    # suffixes of an item's terms, the weakest term last
    w = Window.partitionBy("item_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    plan = bounds.select("item_id", "term", "most", F.coalesce("kth", F.lit(0)).alias("threshold"), F.sum("most").over(w).alias("suffix"))
    plan = written(plan.withColumn("essential", F.col("suffix") >= F.col("threshold")), "plan")
    rest = plan.groupBy("item_id").agg(F.coalesce(F.max(F.when(~F.col("essential"), F.col("suffix"))), F.lit(0)).alias("rest"), F.max("threshold").alias("threshold"))
    # documents with essential terms that can reach the threshold
    some = postings.join(_small(plan.filter("essential").select("item_id", "term"), n_wanted), "term")
    some = some.groupBy("item_id", "row").agg(F.sum("impact").alias("part"))
    some = written(some.join(_small(rest, n_wanted), "item_id").filter(F.col("part") + F.col("rest") >= F.col("threshold")), "candidates")
    scored = _rescored(some.select("item_id", "row", "part"), plan.filter("NOT essential"), n_wanted, postings, k).filter("part > 0")
    ids = found.select("row", "doc_id").join(_small(scored.select("row").distinct(), scored.count()), "row", "left_semi")
    scored = scored.join(ids, "row").withColumnRenamed("part", "score")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_MATCHES = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
SQL = f"""WITH tok AS (SELECT doc_id, {_MATCHES} FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_MATCHES} FROM benchmark)),
wts AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
scored AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN tf ON tf.term = asked.term JOIN wts ON wts.term = tf.term JOIN len ON len.doc_id = tf.doc_id, tot GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {K}"""
