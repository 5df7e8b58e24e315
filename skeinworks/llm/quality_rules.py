"""Learned decision lists over text statistics, grown and applied in DataFrame operations.

Sequential covering: a rule is a conjunction of threshold conditions that picks bad documents. It
is grown condition by condition by FOIL gain over the growing part of the labelled rows, then
pruned from its end over the other part, and the rows it covers leave both parts. Each step asks
Spark for one histogram, whose size depends on the statistics and thresholds alone; the rows stay
where they are. The list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.statistics import FEATURES, with_statistics
from skeinworks.runtime import materialize

#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` if ``below``, else ``feature > threshold``."""

    feature: str
    below: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) <= self.threshold if self.below else F.col(self.feature) > self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a document as bad, with its counts on the pruning rows."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1, else 0: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def _thresholds(rows: DataFrame, features: tuple[str, ...], n: int) -> dict[str, list[float]]:
    """Cuts of each statistic: midway between neighbouring quantiles of good and of bad rows."""
    at = F.lit([(k + 0.5) / n for k in range(n)])
    got = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).collect()
    seen = {f: sorted({float(x) for r in got for x in r[f] or ()}) for f in features}
    return {f: [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for f, x in seen.items()}


def _histograms(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """By statistic and bin, how many good and how many bad rows; bin k is at most cut k."""
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in cuts])).alias("x")
    got = rows.select("bad", bins).groupBy("x.f", "x.b").agg(F.sum(F.lit(1) - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect()
    out = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
    for r in got:
        out[r["f"]][r["b"]] = [r["good"], r["bad"]]
    return out


def _best(hist: dict[str, list[list[int]]], cuts: dict[str, list[float]], least: int) -> tuple[float, Condition | None]:
    """The condition of most FOIL gain that leaves ``least`` bad rows."""
    top: tuple[float, Condition | None] = (0.0, None)
    for f, counts in hist.items():
        good, bad = (sum(c[k] for c in counts) for k in (0, 1))
        if not bad:
            continue
        before, g, b = math.log2(bad / (good + bad)), 0, 0
        for k, cut in enumerate(cuts[f]):
            g, b = g + counts[k][0], b + counts[k][1]
            for below, p, n in ((True, b, g), (False, bad - b, good - g)):
                if p >= least and p + n < good + bad:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > top[0] + 1e-9:
                        top = (gain, Condition(f, below, cut))
    return top


def learn_rules(
    rows: DataFrame,
    *,
    features: tuple[str, ...] = FEATURES,
    bins: int = 16,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_bad: int = 8,
    min_precision: float = 0.8,
) -> list[Rule]:
    """An ordered list of rules that pick the rows whose ``bad`` is 1.

    ``rows``: ``doc_id``, ``bad`` (0 or 1, no nulls) and the statistics, no nulls. A hash of the id
    puts two thirds of them into the growing part. A rule stands if, on the pruning part, at least
    ``min_precision`` of what it picks is bad, and ``min_bad`` rows of the growing part are; growth
    ends with the first that fails. No labels, or labels of one kind: no rules.
    """
    cuts = _thresholds(rows, features, bins)
    if not any(cuts.values()):
        return []
    placed = rows.select(
        "bad",
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"),
        *features,
        *[reduce(lambda a, c, f=f: a + (F.col(f) > c).cast("int"), cuts[f], F.lit(0)).alias(f"bin_{f}") for f in features],
    )
    left, rules = materialize(placed, "rules"), []
    while len(rules) < max_rules:
        inside, conditions = left.where("grow"), []
        while len(conditions) < max_conditions:
            _, found = _best(_histograms(inside, cuts), cuts, min_bad)
            if not found:
                break
            conditions.append(found)
            inside = inside.where(found.column())
        if not conditions:
            break
        counted = left.where(~F.col("grow"))
        prefixes = [Rule(tuple(conditions[:k]), 0, 0) for k in range(1, len(conditions) + 1)]
        got = counted.agg(*[F.count_if(p.column() & (F.col("bad") == b)).alias(f"{b}_{k}") for k, p in enumerate(prefixes) for b in (0, 1)]).first()
        tried = [Rule(p.conditions, got[f"1_{k}"], got[f"0_{k}"]) for k, p in enumerate(prefixes)]
        rule = max(tried, key=lambda r: ((r.bad - r.good) / max(1, r.bad + r.good), r.bad, -len(r.conditions)))
        if rule.bad == 0 or rule.bad < min_precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def apply_quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict of every row of ``docs``, and the rules learned from ``labels``.

    ``docs`` has ``doc_id`` and ``text``; ``labels`` has ``doc_id`` and ``quality``, of which rows
    with a null in either do not count. The rows returned, one per row of ``docs``, have doc_id, the
    statistics, base_failed, rule (of the first that fired, 0 if none) and kept.

    Null text: as an empty one, which fails the base rules. Null doc_id: judged like any other,
    never labelled. Repeated rows: each is judged. A document with several labels counts once for
    each. Ties: of rules that are equally good the first by statistic and threshold is learned. Very long texts:
    whole. No rows: no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "text")), "rule-statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.lit(1) - F.col("quality")).cast("int").alias("bad"))
    rules = learn_rules(stats.where(~F.col("base_failed")).join(marks, "doc_id"), **settings)
    out = stats.withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(verdict(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, with all their columns.

    The statistics of labelled documents are taken first, to learn; then one pass over all rows
    filters them. Nulls, ties, very long texts, repeated rows and empty tables: as in ``apply_quality_rules``.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.lit(1) - F.col("quality")).cast("int").alias("bad"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    labelled = materialize(with_statistics(docs.select("doc_id", "text").join(marks, "doc_id")), "rule-labelled")
    rules = learn_rules(labelled.where(~failed), **settings)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("_copy"))
    # A condition over the statistics would be pushed below them, and compute them again for each
    # use and element. A generator is not: it gives one row for each document that is kept.
    kept = F.explode(F.when(~failed & (verdict(rules) == 0), F.array(F.lit(1))))
    return with_statistics(rows, "_copy").select("row", kept.alias("kept")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out, _ = apply_quality_rules(read("documents"), read("labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
