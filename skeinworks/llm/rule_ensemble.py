"""Quality scores by a sparse ensemble of rules, trained with Spark's own trees and lasso.

A small random forest over text statistics gives conjunctive rules: the path from a root to each
node. A logistic model with an L1 penalty over the rules' indicators keeps few of them. What is
left is compiled into one column expression, so that scoring is a projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.statistics import FEATURES, with_statistics
from skeinworks.llm.toxicity import held_out
from skeinworks.runtime import materialize

#: Labelled rows to fit on, at most about.
SAMPLE = 40_000
TREES, DEPTH, PENALTY, SEED = 10, 3, 0.002, 7

_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")

#: A condition: statistic, whether it is at most the threshold, threshold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """``bias`` and the rules that kept a weight; a rule is a conjunction of conditions."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = ()

    def score(self) -> Column:
        """P(label 1) as an expression over the statistics."""
        total = reduce(lambda a, r: a + F.when(condition(r[0]), r[1]).otherwise(0.0), self.rules, F.lit(self.bias))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        text = lambda rule: " and ".join(f"{f} {'<=' if below else '>'} {t:.6g}" for f, below, t in rule)
        return "\n".join([f"{self.bias:+.4f}", *(f"{w:+.4f} if {text(r)}" for r, w in self.rules)])


def condition(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) <= t if below else F.col(f) > t for f, below, t in rule])


def simplified(path: list[Condition]) -> tuple[Condition, ...]:
    """A path with one bound at most for each statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for f, below, t in path:
        known = bounds.get((f, below))
        bounds[f, below] = t if known is None else (min if below else max)(known, t)
    return tuple((f, below, t) for (f, below), t in sorted(bounds.items()))


def tree_rules(description: str, features: tuple[str, ...]) -> list[tuple[Condition, ...]]:
    """The path to every node but the roots, from a forest's ``toDebugString``."""
    rules, path = {}, []
    for line in description.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        if found := _SPLIT.match(line):
            depth = len(found[1])
            path = [(d, c) for d, c in path if d < depth]
            path.append((depth, (features[int(found[3])], found[4] == "<=", float(found[5]))))
            rules[simplified([c for _, c in path])] = None
    return list(rules)


def learn(rows: DataFrame, *, features: tuple[str, ...] = FEATURES, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """A model from ``doc_id``, ``label`` (0 or 1) and the statistics of the rows to learn from.

    About ``sample`` rows, or all if fewer, chosen by a hash of the id, are fitted on. Without both
    classes: a model that scores all by the labels' share.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if not bad or not good:
        share = (good + 0.5) / (good + bad + 1)
        return RuleModel(math.log(share / (1 - share)))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = materialize(rows.where(place < sample / (good + bad)).select(F.col("label").cast("double").alias("label"), *features), "rule-rows")
    vectors = VectorAssembler(inputCols=list(features), outputCol="statistics").transform(chosen)
    forest = RandomForestClassifier(featuresCol="statistics", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=SEED)
    rules = tree_rules(forest.fit(vectors).toDebugString, features)
    if not rules:
        return RuleModel(math.log(good / bad))
    marks = chosen.select("label", *[condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    marks = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(marks)
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=100)
    fitted = lasso.fit(marks.select("label", "rules"))
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(fitted.intercept, tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def score_quality(docs: DataFrame, labels: DataFrame, learns: Column | None = None, **settings) -> tuple[DataFrame, RuleModel]:
    """``doc_id``, ``score`` and the statistics of every row of ``docs``, and the model.

    ``labels`` has ``doc_id`` and ``quality``; rows with a null in either do not count. ``learns``, a
    condition on doc_id, says which documents' labels may be learned from; all by default.

    Null or empty text: scored by its statistics, all zero. Null doc_id: scored, never learned from.
    Repeated rows: scored each, alike; a document with several labels counts once for each. Ties: texts of equal
    statistics have equal scores. Very long texts: whole. No rows: no rows. Other columns of ``docs`` are
    not read, whatever their names.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "text")), "quality-statistics")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = stats if learns is None else stats.where(learns)
    model = learn(rows.join(marks, "doc_id"), **settings)
    return stats.withColumn("score", model.score()), model


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kept = held_out(3, 1)
    out, _ = score_quality(read("documents"), read("labels"), ~kept)
    return out.select("doc_id", kept.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
