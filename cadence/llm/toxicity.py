"""Toxicity: a counterfactually regularised classifier.

A logistic model over the presence of words and of word beginnings in a
document. Training minimises log loss plus an L1 penalty plus, for every
labelled text with identity terms, the squared change of its score when each
term is swapped for another term of its group. A group's mere mention then
cannot move a score, which spares neutral mentions that share documents with
toxic words.

The feature dictionary and the weights are learnt on a bounded, documented
sample of labelled rows; every whole text is scored in an Arrow function.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import WordTable, as_texts, held_out, read_table, ship_package, text_slices

#: Terms of groups of people, by kind; a swap stays within its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("blind", "deaf", "disabled", "elderly"),
)
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """Features of a lower-case word: itself, and its longer beginnings (marked ^)."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    weights: dict[str, float]


class _Places:
    """Places of features in word sets; the places of each word are worked out once."""

    def __init__(self, place: dict[str, int]) -> None:
        self.place, self.of_word = place, {}

    def of(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            got = self.of_word.get(w)
            if got is None:
                got = self.of_word[w] = tuple(self.place[f] for f in features_of(w) if f in self.place)
            if got:
                out.update(got)
        return out

    def matrix(self, docs: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(docs), len(self.place)), dtype=np.float32)
        for row, words in enumerate(docs):
            x[row, list(self.of(words))] = 1.0
        return x


def _counts(docs: list[set[str]], places: _Places) -> np.ndarray:
    out = np.zeros(len(places.place), dtype=np.int64)
    for words in docs:
        out[list(places.of(words))] += 1
    return out


def counterfactuals(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The word set with its identity terms swapped: for each shift, every term
    is replaced by the term so many places on in its kind."""
    kinds = [(kind, [t for t in kind if t in words]) for kind in terms]
    kinds = [(kind, held) for kind, held in kinds if held]
    if not kinds:
        return []
    out = []
    for shift in range(1, max(len(kind) for kind, _ in kinds)):
        gone = {t for _, held in kinds for t in held}
        new = {kind[(kind.index(t) + shift) % len(kind)] for kind, held in kinds for t in held}
        out.append((words - gone) | new)
    return out


def fit_weights(
    docs: list[set[str]],
    labels: list[int],
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    most_features: int = 1200,
    least_docs: int = 5,
    l1: float = 1e-4,
    fairness: float = 4.0,
    rounds: int = 300,
) -> ToxicityModel:
    """Fit on bounded lists of lower-case word sets and 0/1 labels (numpy, driver).

    Features: those in at least ``least_docs`` toxic texts whose share of toxic
    texts is at least three times the overall share, best first, at most
    ``most_features``; and all identity terms seen. ``fairness`` weighs the mean
    squared score change under swaps. Proximal gradient steps with momentum.
    """
    y = np.asarray(labels, dtype=np.float64)
    ones, n = float(y.sum()), len(y)
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if not ones or ones == n:
        return ToxicityModel(prior, {})
    toxic_docs = [d for d, label in zip(docs, labels, strict=True) if label]
    clean_docs = [d for d, label in zip(docs, labels, strict=True) if not label]
    seen_in = Counter(f for words in toxic_docs for f in {f for w in words for f in features_of(w)})
    often = _Places({f: k for k, f in enumerate(sorted(f for f, c in seen_in.items() if c >= least_docs))})
    toxic, clean = _counts(toxic_docs, often), _counts(clean_docs, often)
    gain = np.log((toxic + 0.5) / (ones + 1)) - np.log((clean + 0.5) / (n - ones + 1))
    by_gain = sorted(often.place, key=lambda f: (-gain[often.place[f]] * np.sqrt(toxic[often.place[f]]), f))
    chosen = [f for f in by_gain if gain[often.place[f]] > np.log(3)][:most_features]
    named = {t for kind in terms for t in kind}
    seen = sorted(named & set().union(*docs))
    place = {f: k for k, f in enumerate(dict.fromkeys([*chosen, *seen]))}
    if not place:
        return ToxicityModel(prior, {})

    places = _Places(place)
    x = places.matrix(docs)
    before, after = [], []
    for words in docs:
        swapped = counterfactuals(words, terms)
        before += [words] * len(swapped)
        after += swapped
    change = places.matrix(after) - places.matrix(before) if after else np.zeros((0, len(place)), dtype=np.float32)
    pull = fairness / max(len(change), 1)

    w, b = np.zeros(len(place)), prior
    look_w, look_b, pace = w.copy(), b, 1.0
    step = 1.0 / (_largest_curvature(x, change, 0.25 / n, 2 * pull) + 0.25)
    for _ in range(rounds):
        slim = look_w.astype(np.float32)
        off = 1.0 / (1.0 + np.exp(-(x @ slim + look_b))) - y
        grad = x.T @ off.astype(np.float32) / n + 2 * pull * (change.T @ (change @ slim))
        new_w = look_w - step * grad
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0.0)
        new_b = look_b - step * off.mean()
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look_w, look_b = new_w + (pace - 1) / new_pace * (new_w - w), new_b + (pace - 1) / new_pace * (new_b - b)
        w, b, pace = new_w, new_b, new_pace
    return ToxicityModel(float(b), {f: float(w[k]) for f, k in place.items() if w[k]})


def _largest_curvature(x: np.ndarray, change: np.ndarray, a: float, c: float) -> float:
    """The largest eigenvalue of a x'x + c change'change, by power iteration, with a margin."""
    v = np.ones(x.shape[1], dtype=np.float32)
    size = 1.0
    for _ in range(30):
        v = a * (x.T @ (x @ v)) + c * (change.T @ (change @ v))
        size = float(np.linalg.norm(v))
        v = (v / max(size, 1e-12)).astype(np.float32)
    return 1.1 * size


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Probability of label 1 of a whole text: the sum over the distinct
    features present in it. Null counts as empty and scores the intercept."""

    weights, intercept = model.weights, model.intercept

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        table = WordTable(lambda words: [tuple(f for w in _WORD.findall(x) for f in features_of(w) if f in weights) for x in words])
        scores: list[float] = []
        for part in text_slices(as_texts(texts)):
            words = pc.utf8_split_whitespace(pc.utf8_lower(part))
            ends = np.asarray(words.offsets)
            ends = ends - ends[0]
            coded = words.flatten().dictionary_encode()
            held = table.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            hits = np.array([bool(h) for h in held], dtype=bool)
            codes = np.asarray(coded.indices)
            at = np.flatnonzero(hits[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
            found: list[set[str]] = [set() for _ in range(len(part))]
            for row, code in zip((np.searchsorted(ends, at, side="right") - 1).tolist(), codes[at].tolist(), strict=True):
                found[row].update(held[code])
            scores += [1.0 / (1.0 + np.exp(-(intercept + sum(weights[f] for f in sorted(fs))))) for fs in found]
        return pa.array(scores, type=pa.float64())

    return of(text)


def word_sets(text: Column) -> Column:
    """The distinct lower-case words of a whole text, in order."""

    @arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(_WORD.findall(x.as_py().lower()))) for x in as_texts(texts)], type=pa.list_(pa.string()))

    return of(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 8_000, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Learn from at most ``most`` labelled rows, chosen by the hash of their
    ids; held-out rows and null ids or labels take no part, of several labels of
    an id the largest counts. What the driver gathers is the distinct words of
    those rows."""
    ship_package(docs.sparkSession)
    chosen = labels.where(~held_out(F.col("doc_id"))).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # a bounded number of (id, label) pairs
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
    got = rows.select(word_sets(F.col("text")).alias("words"), "label").toArrow()
    return fit_weights([set(x) for x in got["words"].to_pylist()], got["label"].to_pylist(), terms)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Null and empty texts have no features and score the intercept's
    probability; a null doc_id counts as held out. Repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_from_tables(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    return fit_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
