"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. ``text_statistics`` measures every whole text (an Arrow function, numpy
   counts of bytes and words).
2. Shallow trees are grown on the labelled statistics (Spark ML random forest);
   every path from a root to a node is a rule, a conjunction of
   ``statistic <= x`` and ``statistic > x``.
3. A lasso logistic regression over the rules' truth values keeps the rules
   that matter and gives them weights.
4. The kept rules are compiled into one Spark column expression, which scores
   documents inside the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import as_texts, held_out, materialise, read_table, ship_package, spare_name, text_slices

#: Statistics of a text, each a share or a mean and so free of its length,
#: except for the logarithms of its size.
STATISTICS = (
    "log_words", "mean_word", "upper_share", "digit_share", "space_share", "symbol_share", "punctuation_share",
    "stop_share", "high_share", "distinct_words", "top_word_share", "line_words", "distinct_lines",
)
_BYTES = np.arange(256)
_ASCII = [chr(b) for b in range(128)] + ["\0"] * 128
_CLASSES = np.stack(
    [
        np.array([c.isupper() for c in _ASCII]),
        np.array([c.isdigit() for c in _ASCII]),
        np.array([c in " \t\n\v\f\r" for c in _ASCII]),
        np.array([c in "#$%&*+/<=>@\\^_`{|}~[]" for c in _ASCII]),
        np.array([c in "!\"'(),-:;?" for c in _ASCII]),
        np.array([c == "." for c in _ASCII]),
        _BYTES >= 0xC0,  # first bytes of characters beyond ASCII
        (_BYTES & 0xC0) != 0x80,  # first bytes of all characters
    ]
).T.astype(np.float64)


def statistics_of(text: str) -> list[float]:
    """STATISTICS of one text; of an empty text all are zero."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256) @ _CLASSES
    n = max(counts[-1], 1.0)
    words = text.split()
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    m = max(len(words), 1)
    upper, digit, space, symbol, mark, stop, high, _ = counts
    return [
        float(np.log1p(len(words))), (n - space) / m if words else 0.0, upper / n, digit / n, space / n, symbol / n, mark / n,
        stop / n, high / n, len(tally) / m, max(tally.values(), default=0) / m, float(np.log1p(m / max(len(lines), 1))), len(set(lines)) / max(len(lines), 1),
    ]


def text_statistics(text: Column) -> Column:
    """STATISTICS of a whole text as an array of doubles; null counts as empty."""

    @arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(x.as_py()) for part in text_slices(texts) for x in as_texts(part)], type=pa.list_(pa.float64()))

    return of(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic's place, greater, threshold), and its lasso weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, greater, x in self.terms:
            out = out & ((stats[k] > F.lit(x)) if greater else (stats[k] <= F.lit(x)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if g else '<='} {x:.6g}" for k, g, x in self.terms)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1, as a Spark expression over the statistics."""
        z = F.lit(self.intercept)
        for rule in self.rules:
            z = z + F.when(rule.column(stats), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_SPLIT = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_paths(printed: str) -> list[Rule]:
    """Every path from a root to a node of a printed forest
    (``model.toDebugString``), as distinct rules in the order of printing."""
    found: dict[tuple, None] = {}
    path: list[tuple[int, tuple]] = []  # (indent, conjunction so far)
    for line in printed.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        indent = len(m[1])
        while path and path[-1][0] >= indent:
            path.pop()
        terms = _tightened(path[-1][1] if path else (), (int(m[2]), m[3] == ">", float(m[4])))
        path.append((indent, terms))
        found.setdefault(terms)
    return [Rule(t) for t in found]


def _tightened(terms: tuple, term: tuple) -> tuple:
    """The conjunction with ``term``, one bound per statistic and side, in sorted order."""
    bounds = {(k, g): x for k, g, x in terms}
    k, g, x = term
    old = bounds.get((k, g))
    bounds[k, g] = x if old is None else (max(x, old) if g else min(x, old))
    return tuple((k, g, bounds[k, g]) for k, g in sorted(bounds))


def fit_rules(stats: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on rows (stats array<double>, label 0/1). Rows with a null label are
    left out; with one class or no rows at all, the score is that class's
    smoothed share."""
    # here, so that Python workers need not import Spark ML
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = materialise(stats.where("label is not null").select("stats", F.col("label").cast("double").alias("label")))
    counts = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}  # two rows at most
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if not ones or not zeros:
        return RuleEnsemble(prior, ())
    forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.8, maxBins=64)
    rules = tree_paths(forest.fit(rows.select("label", array_to_vector("stats").alias("x"))).toDebugString)
    if not rules:
        return RuleEnsemble(prior, ())
    truth = F.array(*[r.column(F.col("stats")).cast("double") for r in rules])
    # rows with the same truth values are one weighted row: the lasso works on
    # the distinct patterns of the rules, not on the rows
    patterns = materialise(rows.select("label", truth.alias("t")).groupBy("label", "t").agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1))
    lasso_fit = LogisticRegression(featuresCol="x", weightCol="n", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60)
    model = lasso_fit.fit(patterns.select("label", "n", array_to_vector("t").alias("x")))
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w)
    return RuleEnsemble(float(model.intercept), kept)


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> DataFrame:
    """(stats, label) of the labelled documents that may be learnt from.

    ``most`` bounds the labelled rows: those with the smallest hashes of their
    ids, so that the choice does not depend on the order of the rows. Rows with
    a null id or label, held-out rows, and all but one label of an id (the
    smallest) take no part.
    """
    ship_package(docs.sparkSession)
    chosen = labels.where(~held_out(F.col("doc_id"))).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # a bounded number of (id, label) pairs: ``most`` of 12 bytes
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.select(text_statistics(F.col("text")).alias("stats"), "label")


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_rules) per row of ``docs``.

    Null and empty texts have all statistics zero and get the score that the
    rules give those; a null doc_id counts as held out. Repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    stats = docs.select("doc_id", text_statistics(F.col("text")).alias("stats"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(len(model.rules)).alias("n_rules"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; all columns stay."""
    ship_package(docs.sparkSession)
    stats = spare_name(docs, "stats")
    marked = docs.withColumn(stats, text_statistics(F.col("text")))
    return marked.where(model.score(F.col(stats)) >= threshold).select(*docs.columns)


def fit_from_tables(spark: SparkSession, sf_dir: str) -> RuleEnsemble:
    """The ensemble learnt from ``documents`` and ``labels`` of ``sf_dir``."""
    return fit_rules(labelled_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
