"""Line de-duplication by site-relative frequency.

A line's ratio is the number of a host's pages that contain it over the number of the host's pages. Lines above the
ratio are boilerplate of that host and leave its pages. Only per-host tables of such lines come out of the counting,
and a host has at most (lines of a page on average) / ratio of them, however many pages it has.

Defined results: null texts and rows without a host stay as they are; lines without a word are never boilerplate; a
repeated line of a page counts once for that page; repeated rows are pages of their own; hosts with fewer than
``min_pages`` pages keep all lines, as do lines on fewer than ``min_copies`` pages; an empty table gives an empty
table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import table, written

MAX_RATIO = 0.08
MIN_PAGES = 20
MIN_COPIES = 5
#: The table of boilerplate lines is broadcast up to so many lines (8 bytes each), and joined by shuffle beyond.
BROADCAST_LINES = 200_000
#: Tasks that the pages of a host are dealt to where that table isn't broadcast.
SALTS = 32


def _worded(line):
    return F.translate(line, "\t\x0b\x0c\r ", "") != ""


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES) -> DataFrame:
    """(host, line): 64-bit hashes of the lines above the ratio."""
    pages = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    lines = F.filter(F.split("text", "\n"), _worded)
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    copies = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") >= min_copies)
    return copies.join(totals, "host").filter(F.col("copies") > max_ratio * F.col("pages")).select("host", "line")


def without_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", whole_copies: bool = False, **limits) -> DataFrame:
    """pages with the text less its host's boilerplate, and ``ld_lines`` and ``ld_dropped``, numbers of lines.

    With ``whole_copies`` a page that would keep no line with a word stays as it is: it is a copy of a frequent page."""
    found = written(boilerplate(pages, host, text, **limits), "boilerplate")
    by_host = found.groupBy(F.col("host").alias("ld_host")).agg(F.collect_list("line").alias("ld_bad"))
    on = F.col(host) == F.col("ld_host")
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    else:  # a host's pages are dealt to several tasks by their hash, each of which gets the host's lines
        plain = [c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
        pages = pages.withColumn("ld_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
        by_host = by_host.withColumn("ld_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("ld_salt") == F.col("ld_part"))
    out = pages.join(by_host, on, "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("ld_bad", F.xxhash64(x)))
    out = out.withColumn("ld_lines", F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"))
    out = out.withColumn("ld_kept", F.when(F.col("ld_bad").isNotNull(), kept))
    if whole_copies:
        out = out.withColumn("ld_kept", F.when(F.exists("ld_kept", _worded), F.col("ld_kept")))
    out = out.withColumn("ld_dropped", F.when(F.col("ld_kept").isNull(), 0).otherwise(F.col("ld_lines") - F.size("ld_kept")).cast("long"))
    changed = F.when(F.col("ld_dropped") > 0, F.array_join("ld_kept", "\n")).otherwise(F.col(text))
    return out.withColumn(text, changed).drop("ld_host", "ld_bad", "ld_kept", "ld_salt", "ld_part")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(pages).select("doc_id", "source", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), "text")


SQL = rf"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= {MIN_PAGES}),
copies AS (
  SELECT source, line, count(*) AS copies
  FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line HAVING count(*) >= {MIN_COPIES}
),
bad AS (
  SELECT source, list(line) AS bad FROM copies JOIN totals USING (source) WHERE copies > {MAX_RATIO}::DOUBLE * pages GROUP BY source
)
SELECT doc_id, p.source AS source, coalesce(len(lines), 0)::BIGINT AS n_lines,
  CASE WHEN bad IS NULL OR lines IS NULL THEN 0 ELSE len([x FOR x IN lines IF list_contains(bad, x)]) END::BIGINT AS n_dropped,
  CASE WHEN bad IS NULL OR lines IS NULL THEN text ELSE array_to_string([x FOR x IN lines IF NOT list_contains(bad, x)], chr(10)) END AS text
FROM pages p LEFT JOIN bad ON p.source = bad.source
"""
