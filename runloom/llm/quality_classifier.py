"""Operator 4: a sparse rule ensemble for text quality.

Statistics of a text (character shares, repetition, lengths) are computed in one Arrow pass over its
bytes. A small random forest is grown on labelled rows; every path from a root to a node is a rule, a
conjunction of bounds on statistics. A logistic regression with an L1 penalty over all rules keeps
few of them. These are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import saved

STATISTICS = ("words", "chars", "word_chars", "symbols", "marks", "capitals", "digits", "breaks", "repeats", "distinct", "same_lines")
#: Labelled rows that train a model, at most; those with the least hash of their id.
SAMPLE_ROWS = 20_000
ACCEPTED = 0.7


def _members(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_SYMBOLS, _MARKS = _members(b"#*$%&|<>"), _members(b"!\"'()+,-./:;=?@[\\]^_`{}~")
_CAPITALS, _DIGITS, _STARTS = _members(bytes(range(65, 91))), _members(bytes(range(48, 58))), ~_members(bytes(range(128, 192)))


def statistics_of(text: bytes | None) -> tuple[float, ...]:
    """STATISTICS of a text; all zero for a null or empty one. Shares are of characters, words or lines."""
    if not text:
        return (0.0,) * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    chars, n = int(seen[_STARTS].sum()) or 1, len(words) or 1
    share = [float(seen[c].sum()) / chars for c in (_SYMBOLS, _MARKS, _CAPITALS, _DIGITS)]
    return (
        float(len(words)), float(chars), sum(map(len, words)) / n, *share, float(seen[10]) / chars,
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, 1 - len(set(lines)) / (len(lines) or 1),
    )


def _statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = np.array([statistics_of(t.as_py()) for t in batch]).reshape(-1, len(STATISTICS))
        yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], STATISTICS)


def statistics(text: Column) -> Column:
    kind = ", ".join(f"{name}: double" for name in STATISTICS)
    return F.arrow_udf(_statistics, f"struct<{kind}>")(text.cast("binary"))


@dataclass(frozen=True)
class Bound:
    name: str
    above: bool
    limit: float

    def column(self, of: Column) -> Column:
        return of[self.name] > self.limit if self.above else of[self.name] <= self.limit


Rule = tuple[Bound, ...]


def tightest(path: list[Bound]) -> Rule:
    """A path with one bound for each statistic and side, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for b in path:
        old = best.get((b.name, b.above), b.limit)
        best[b.name, b.above] = max(old, b.limit) if b.above else min(old, b.limit)
    return tuple(Bound(*k, limit) for k, limit in sorted(best.items()))


def paths(tree: str, names: tuple[str, ...] = STATISTICS) -> set[Rule]:
    """Rules of a tree in Spark's text form: all nodes but the root."""
    found, stack = set(), []
    for depth, index, sign, limit in re.findall(r"^( +)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$", tree, re.M):
        del stack[len(depth) - 2 :]
        stack.append(Bound(names[int(index)], sign == ">", float(limit)))
        found.add(tightest(stack))
    return found


def conjunction(rule: Rule, of: Column) -> Column:
    """Whether all bounds of a rule hold."""
    out = F.lit(True)
    for bound in rule:
        out = out & bound.column(of)
    return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, of: Column) -> Column:
        """Probability of label 1, from a column of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(conjunction(rule, of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, label: str = "label", trees: int = 16, depth: int = 3, penalty: float = 0.0005, seed: int = 11) -> RuleEnsemble:
    """Fits on ``rows`` with the columns stats (struct) and ``label`` (0 or 1). With one class only, the score is that class, softened; without rows it is 1/2."""
    ones, n = rows.agg(F.sum(label), F.count(label)).first()
    if not n or ones in (0, n):
        return RuleEnsemble(math.log(((ones or 0) + 1) / (n - (ones or 0) + 1)), ())
    flat = rows.select(F.col(label).cast("double").alias("label"), "stats", *(F.col(f"stats.{s}").alias(s) for s in STATISTICS))
    flat = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="0.6", seed=seed).fit(flat)
    rules = sorted(set().union(*(paths(t.toDebugString) for t in forest.trees)), key=repr)
    if not rules:
        return RuleEnsemble(math.log(ones / (n - ones)), ())
    held = [F.when(conjunction(r, F.col("stats")), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(flat.select("label", *held)).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=40).fit(matrix)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """The ensemble for ``docs`` (doc_id, text), from ``labels`` (doc_id, quality) outside of the held-out rows.

    Null labels and labels without a document are ignored; of several labels of a row the least counts.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows of two numbers
    rows = saved(rows.select("doc_id", "label", statistics(F.col("text")).alias("stats")))
    even = rows.repartition(4, "doc_id").sortWithinPartitions("doc_id").select("label", "stats").persist()
    try:
        return fit(even)
    finally:
        even.unpersist()


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` with score and predicted (1 if the score is at least 0.7); an earlier score or predicted is replaced."""
    held = docs.drop("score", "predicted").withColumn("_stats", statistics(F.col("text")))
    held = held.withColumn("score", model.score(F.col("_stats"))).drop("_stats")
    return held.withColumn("predicted", (F.col("score") >= ACCEPTED).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have all statistics zero and are scored like others. A null doc_id is not
    held out. Repeated rows get equal scores; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored(docs, train(docs, labels, sample_rows)).select("doc_id", out.alias("held_out"), "score", "predicted")
