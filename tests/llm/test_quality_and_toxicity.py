import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import quality, toxicity
from cadence.llm.common import read_table

SF = "/root/testdata/sf0.01"


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return np.mean([r[0] == r[1] for r in rows]), len(rows)


@pytest.fixture(scope="module")
def rules(spark):
    return quality.fit_from_tables(spark, SF)


def test_quality_held_out_accuracy(spark, rules):
    scored = quality.score_quality(read_table(spark, SF, "documents"), rules)
    got, n = accuracy(scored, read_table(spark, SF, "labels"), "quality")
    assert n > 50 and got >= 0.9


def test_compiled_rules_equal_python(spark, rules):
    texts = [r.text for r in read_table(spark, SF, "documents").limit(40).collect()] + ["", "x", "A!! B!!"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(rows, rules).collect()}
    for k, t in enumerate(texts):
        s = quality.statistics_of(t)
        z = rules.intercept + sum(r.weight for r in rules.rules if all((s[a] > x) == g for a, g, x in r.terms))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_tree_paths_are_conjunctions():
    printed = "Tree 0\n   If (feature 2 <= 0.5)\n    If (feature 1 <= 3.0)\n     Predict: 0.0\n    Else (feature 1 > 3.0)\n     Predict: 1.0\n   Else (feature 2 > 0.5)\n    Predict: 1.0\n"
    assert [r.terms for r in quality.tree_paths(printed)] == [((2, False, 0.5),), ((1, False, 3.0), (2, False, 0.5)), ((1, True, 3.0), (2, False, 0.5)), ((2, True, 0.5),)]


def test_quality_odd_rows(clashing, rules):
    got = quality.score_quality(clashing, rules).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].score == by_id[2].score and by_id[None].held_out
    assert by_id[4].held_out == (zlib.crc32(b"4") % 5 == 0)
    assert quality.keep_good(clashing, rules).columns == clashing.columns
    assert quality.score_quality(clashing.limit(0), rules).count() == 0


def test_quality_without_labels_or_with_one_class(spark):
    none = spark.createDataFrame([], "stats array<double>, label int")
    assert quality.fit_rules(none).rules == ()
    one = spark.createDataFrame([([0.0] * 13, 1)] * 3, "stats array<double>, label int")
    assert quality.fit_rules(one).intercept > 0


def test_nothing_is_learnt_from_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    kept = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(200))
    assert quality.labelled_statistics(docs, labels).count() == kept


def test_toxicity_held_out(spark):
    model = toxicity.fit_from_tables(spark, "/root/testdata/sf0.1")
    scored = toxicity.score_toxicity(read_table(spark, "/root/testdata/sf0.1", "documents"), model)
    got, n = accuracy(scored, read_table(spark, "/root/testdata/sf0.1", "labels"), "toxic")
    assert n > 500 and got >= 0.97


def test_counterfactual_penalty_spares_neutral_mentions():
    """Toxic texts mostly mention one group; without the penalty its name is toxic."""
    rng = np.random.default_rng(0)
    filler = [f"w{chr(97 + k)}x" for k in range(20)]
    docs, labels = [], []
    for k in range(600):
        words = set(rng.choice(filler, 5).tolist())
        toxic = k % 3 == 0
        if toxic:
            words |= {"idiot"} if rng.random() < 0.7 else set()
            words |= {"muslims"} if rng.random() < 0.8 else {"hindus"}
        elif rng.random() < 0.05:
            words |= {"muslims"}
        elif rng.random() < 0.3:
            words |= {"hindus"}
        docs.append(words)
        labels.append(int(toxic))
    plain = toxicity.fit_weights(docs, labels, fairness=0.0)
    fair = toxicity.fit_weights(docs, labels, fairness=20.0)
    gap = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("hindus", 0))
    score = lambda m, ws: m.intercept + sum(m.weights.get(f, 0) for f in {f for w in ws for f in toxicity.features_of(w)})
    assert gap(fair) < 0.2 * gap(plain)
    assert score(plain, {"muslims", filler[0]}) > 0 > score(fair, {"muslims", filler[0]})
    assert score(fair, {"idiot", "hindus", filler[1]}) > 0


def test_swaps_stay_within_a_kind():
    out = toxicity.counterfactuals({"women", "x"}, toxicity.IDENTITY_TERMS)
    assert [sorted(w) for w in out] == [["men", "x"], ["girls", "x"], ["boys", "x"]]


def test_toxicity_odd_rows(clashing):
    model = toxicity.ToxicityModel(-2.0, {"word1": 5.0, "^word": 0.5})
    got = {r.doc_id: r for r in toxicity.score_toxicity(clashing, model).collect()}
    assert got[1].score == got[2].score == pytest.approx(1 / (1 + np.exp(2.0)))
    assert got[4].score == pytest.approx(1 / (1 + np.exp(1.5)))  # digits are no letters: only ^word
    assert toxicity.score_toxicity(clashing.limit(0), model).count() == 0
    assert toxicity.fit_weights([], []).weights == {}
