"""Quality rules: a learned decision list over text statistics, all in DataFrame functions.

``statistics`` measures every whole text, ``fit`` learns an ordered list of threshold conjunctions by sequential
covering from labelled statistics, and ``DecisionList.verdict`` is the list as one ordered Spark conditional.

Defined results: a null or empty text has no words and fails the base rules; tied rules keep the first in feature and
threshold order; repeated rows get the same verdict each; an empty table gives an empty table; other columns pass
through untouched; without labels of both kinds the list is empty and keeps what the base rules keep. A doc_id whose labels
disagree isn't learned from, one that repeats in the documents is learned from once, by its text that sorts first: so the
list doesn't depend on the order of rows. A text of any length is measured whole; its words lie in one row's memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import documents, table, written

#: Labelled rows that the list is learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 10_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FEATURES = ("word_length", "symbol_ratio", "bang_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "line_words")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics and the learner's features, names prefixed by ``q_``; texts are measured whole.

    A window of 8 words is known by a 64-bit hash of its words, so the arrays hold a long per word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("q_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn("q_lines", F.filter(F.split(t, "\n"), lambda x: F.translate(x, "\t\x0b\x0c\r ", "") != ""))
    out = out.withColumn("q_n_words", F.size("q_words").cast("long"))
    out = out.withColumn(
        "q_hashes",
        F.when(F.col("q_n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("q_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("q_words", i, WINDOW)))),
    )
    out = out.withColumn(
        "q_sorted",
        F.when(F.size(F.array_distinct("q_hashes")) < F.size("q_hashes"), F.sort_array(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    )
    again = F.filter("q_sorted", lambda x, i: (F.get("q_sorted", i - 1)["h"] == x["h"]) | (F.get("q_sorted", i + 1)["h"] == x["h"]))
    out = out.withColumn("q_repeats", F.sort_array(F.transform(again, lambda x: x["p"])))
    covered = F.aggregate(
        "q_repeats",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
    )["n"]
    bare = F.translate(t, "\t\n\x0b\x0c\r ", "")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    out = (
        out.withColumn("q_word_chars", F.length(bare).cast("long"))
        .withColumn("q_n_symbols", count("#*$%&|<>"))
        .withColumn("q_n_lines", F.size("q_lines").cast("long"))
        .withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
        .withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("q_n_distinct", F.size(F.array_distinct("q_words")).cast("long"))
        .withColumn("q_n_bangs", count("!"))
        .withColumn("q_n_upper", (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"))
        .drop("q_words", "q_lines", "q_hashes", "q_sorted", "q_repeats")
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("q_n_words", "q_word_chars", "q_n_lines"))
    features = {
        "word_length": F.col("q_word_chars") / words,
        "symbol_ratio": F.col("q_n_symbols") / words,
        "bang_ratio": F.col("q_n_bangs") / words,
        "upper_ratio": F.col("q_n_upper") / chars,
        "dup_line_ratio": F.col("q_n_dup_lines") / lines,
        "repeat_ratio": F.col("q_n_repeat_words") / words,
        "distinct_ratio": F.col("q_n_distinct") / words,
        "line_words": F.col("q_n_words") / lines,
    }
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))
    return out.withColumns({f"q_{k}": v for k, v in features.items()} | {"q_base_failed": failed})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"q_{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in conditions), F.lit(True))


@dataclass
class DecisionList:
    """Rules in order; each is a conjunction that rejects. What no rule covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1 for what the first rule covers, and so on; 0 for the default."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(_all(rule), i) if out is None else out.when(_all(rule), i)
        return F.lit(0) if out is None else out.otherwise(0)

    def verdict(self) -> Column:
        return self.rule_number() == 0

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) + " -> reject" for r in self.rules) + "; else keep"


def fit(
    labelled: DataFrame, label: str = "quality", max_rules: int = 6, max_conditions: int = 3, n_thresholds: int = 24, min_covered: int = 8, min_precision: float = 0.95
) -> DecisionList:
    """Sequential covering of the bad rows (label 0) of a bounded labelled table that has ``statistics``.

    Two thirds of the rows (by hash) grow a conjunction by information gain, one third prunes conditions from its end;
    a rule joins the list if the bad share of what it covers is at least ``min_precision`` in both parts, and the rows
    it covers leave. A row is reduced to the number of its interval between thresholds, once for each feature, in a
    written table; every step is one aggregation of it whose result has at most features x thresholds x 2 rows.
    """
    shares = [(i + 0.5) / n_thresholds for i in range(n_thresholds)]
    cells = [F.percentile_approx(F.col(f"q_{f}"), shares, 10_000).alias(f) for f in FEATURES]
    bad_cells = [F.percentile_approx(F.when(F.col(label) == 0, F.col(f"q_{f}")), shares, 10_000).alias(f"bad_{f}") for f in FEATURES]
    row = labelled.agg(*cells, *bad_cells).first()
    thresholds = [_with_midpoints(sorted({float(x) for x in [*(row[f] or ()), *(row[f"bad_{f}"] or ())]})) for f in FEATURES]
    if not any(thresholds):
        return DecisionList()

    def interval(f: str, ts: list[float]) -> Column:
        """How many thresholds lie below the value."""
        return F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t < F.col(f"q_{f}"))).cast("short").alias(f)

    part = (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune")
    binned = written(labelled.select(part, (F.col(label) == 0).alias("bad"), *[interval(f, ts) for f, ts in zip(FEATURES, thresholds) if ts]), "binned-labels")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("bin")) for k, (f, ts) in enumerate(zip(FEATURES, thresholds)) if ts])).alias("x")
    found = DecisionList()

    def holds(rule) -> Column:
        return reduce(lambda a, b: a & b, (F.col(FEATURES[k]) > j if above else F.col(FEATURES[k]) <= j for k, above, j in rule), F.lit(True))

    def counts(rows: Column) -> dict:
        """By part, feature and number of thresholds: (bad, good) rows of no greater interval; the last is all rows."""
        got = binned.filter(rows).select("prune", "bad", pairs).groupBy("prune", "x.k", "x.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        by = {(r["prune"], r["k"], r["bin"]): (r["bad"], r["good"]) for r in got}
        sums = {}
        for prune in (False, True):
            for k, ts in enumerate(thresholds):
                each = [by.get((prune, k, j), (0, 0)) for j in range(len(ts) + 1)]
                sums[prune, k] = [*zip(accumulate(b for b, _ in each), accumulate(g for _, g in each))]
        return sums

    def split(sums: dict, prune: bool, k: int, above: bool, j: int) -> tuple[int, int]:
        low, every = sums[prune, k][j], sums[prune, k][-1]
        return (every[0] - low[0], every[1] - low[1]) if above else low

    rest = F.lit(True)
    while len(found.rules) < max_rules:
        rule, trail = (), []
        while len(rule) < max_conditions:
            by = counts(rest & holds(rule))
            bad, good = by[False, next(k for k, ts in enumerate(thresholds) if ts)][-1]
            if not bad or not good and rule:
                break
            base, best, tied = math.log2(bad / (bad + good)), 1e-9, []
            for k, ts in enumerate(thresholds):
                for above in (True, False):
                    for j in range(len(ts)):
                        b, g = split(by, False, k, above, j)
                        gain = b * (math.log2(b / (b + g)) - base) if b >= min_covered else 0.0
                        if gain > best + 1e-9:
                            best, tied = gain, [(k, above, j)]
                        elif tied and gain > best - 1e-9 and tied[0][:2] == (k, above):
                            tied.append((k, above, j))
            if not tied:
                break
            chosen = tied[len(tied) // 2]  # of thresholds that part the rows alike, the middle one
            rule = (*rule, chosen)
            trail.append((split(by, False, *chosen), split(by, True, *chosen)))
        while len(rule) > 1 and _worth(trail[-2][1]) >= _worth(trail[-1][1]) and _share(trail[-2][0]) >= min_precision:
            rule, trail = rule[:-1], trail[:-1]
        if not rule or _share(trail[-1][0]) < min_precision or _share(trail[-1][1]) < min_precision:
            break
        found.rules.append(tuple(Condition(FEATURES[k], above, thresholds[k][j]) for k, above, j in rule))
        rest = rest & ~holds(rule)
    return found


def _with_midpoints(values: list[float]) -> list[float]:
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})


def _worth(counted: tuple[int, int]) -> float:
    bad, good = counted
    return (bad - good) / (bad + good) if bad + good else -1.0


def _share(counted: tuple[int, int]) -> float:
    bad, good = counted
    return bad / (bad + good) if bad + good else 1.0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The list learned from at most ``sample_rows`` labelled documents that pass the base rules."""
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    chosen = agreed.filter("quality = other").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    measured = statistics(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    keep = ["doc_id", "quality", "q_base_failed", *(f"q_{f}" for f in FEATURES)]
    return fit(written(measured.select(*keep), "labelled-statistics").filter(~F.col("q_base_failed")))


def apply(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs with the statistics, ``q_rule`` (number of the rule that rejects, 0: none) and ``q_kept``.

    The verdict holds a row number, so that no filter on it moves below the projections: there each use of the word
    arrays would be computed anew, for every element of an array.
    """
    kept = ~F.col("q_base_failed") & (F.col("q_rule") == 0) & (F.monotonically_increasing_id() >= 0)
    return statistics(docs).withColumn("q_rule", rules.rule_number()).withColumn("q_kept", kept)


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = apply(docs, learn(docs, table(spark, sf_dir, "labels")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return scored.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names))
