"""The corpus pipeline: quality rules, line de-duplication, near-duplicates, personal data, packing.

Every stage works on all rows that the stage before it kept and returns the columns of ``documents``, but the last,
which returns the pieces of the packed sequences. Null texts fail the quality rules; of rows that repeat a doc_id, the
one whose text (then its other columns) sorts first goes on from the near-duplicate stage; rows without a doc_id aren't
compared there and stay; an empty table gives an empty result; further columns of documents stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import decision_list, line_dedup, near_dedup, packing, pii
from fluvia.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return decision_list.apply(docs, rules).filter("q_kept").select(*docs.columns)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; those of such lines alone stay whole, as the next stage
    keeps one of a group of copies."""
    out = line_dedup.without_boilerplate(docs, whole_copies=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id. Texts are only shuffled where the
    ids that go, or those that repeat, are too many for a broadcast table."""
    named = docs.filter("doc_id IS NOT NULL")
    marked = near_dedup.near_duplicates(named, width=5).groupBy("doc_id")
    marked = written(marked.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT kept"), "near-duplicate-ids")
    gone, again = marked.filter("NOT kept").select("doc_id"), marked.filter("kept").select("doc_id")
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= near_dedup.BROADCAST_IDS else ids
    rest = named.join(bounded(gone), "doc_id", "left_anti")
    order = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and c not in ("doc_id", "text")]
    one = F.min_by(F.struct(*docs.columns), F.struct("text", *order)).alias("row")
    again = bounded(again)
    single = rest.join(again, "doc_id", "left_anti").select(*docs.columns)
    settled = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("row.*")
    return single.unionByName(settled).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked."""
    out = docs.withColumn("text", pii.redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_frequency),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

#: The learned stages have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
