import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import curves, decontaminate

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_hilbert_curve_visits_every_cell_once_by_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curves.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1).tolist()) == {1}


@pytest.mark.parametrize("chunk", [64, 2048])
def test_search_recall_and_ties(spark, monkeypatch, chunk):
    monkeypatch.setattr(curves, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 12)).astype(np.float32)
    x[300:420] = x[300]  # a large group of equal vectors; 300 and 400 are queries
    rows = [(k, v.tolist(), "keep") for k, v in enumerate(x)]
    bad = [(1000, None, ""), (1100, [0.0] * 12, ""), (1200, [float("nan")] * 12, ""), (1300, [1.0, None] * 6, ""), (1400, [1.0], ""), (None, [1.0] * 12, "")]
    frame = spark.createDataFrame(rows + bad + rows[:3], SCHEMA)
    got = {}
    for r in curves.nearest_neighbours(frame, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 10)
    assert set(got) == set(want)
    assert got[300] == [(k, 0.0) for k in range(301, 311)] and got[400] == [(k, 0.0) for k in range(300, 310)]
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    for q in want:
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[v], rel=1e-12) for v, s in got[q] if v in exact)


def test_search_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.0, 1.0], "")], SCHEMA)
    assert [tuple(r) for r in curves.nearest_neighbours(few, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, pytest.approx(2**0.5))]
    assert curves.nearest_neighbours(few.limit(0), F.col("id") % 100 == 0).count() == 0


ITEM = "Yesterday John has 5 apples and gives 2 kg of fruit to her friend Eve near the river, how many are left for John today?"


def test_templates_find_changed_values_and_spare_clean_texts(spark, clashing):
    texts = {
        1: ITEM,
        2: ITEM.replace("John", "Mary").replace("5", "seven").replace("2 kg", "3kg").replace("Eve", "Paul"),
        3: "intro words before. " + ITEM + " and some after",
        4: "Yesterday John went to the market to buy bread and milk for the whole week with her sister.",
        5: None,
        6: "",
    }
    docs = spark.createDataFrame(list(texts.items()) + [(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM), (7, ITEM), (8, None), (6, "a b"), (5, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and {r.item_id for r in got.values()} == {7}
    assert got[2].reparameterised and not got[1].reparameterised and got[1].coverage == 1.0
    assert sorted(r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench).collect()) == [4, 5, 6]
    kept = decontaminate.keep_uncontaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert decontaminate.find_contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contaminated(docs, bench.limit(0)).count() == 0


WORD_PROBLEM = "Tom has 3 apples. Tom buys 4 more apples at the market. Tom gives 2 to Sam. How many apples does Tom have left?"
MID_NAMES = "Yesterday Ann met Bob and Carl near the old mill where Dora sold bread to Emil for 4 coins each morning."


def test_names_at_sentence_starts_and_in_any_case(spark):
    other = WORD_PROBLEM.replace("Tom", "Mary").replace("Sam", "Kim").replace("3", "7").replace("4", "9").replace("2", "5")
    held = [other, other.lower(), other.upper(), "Some words before it. " + other + " And some after.", WORD_PROBLEM, WORD_PROBLEM.lower()]
    mixed = "Tom has 3 apples. Mary buys 9 pears in a shop. Kim gives 5 to Sam. How many plums does Ann want now?"
    docs = [*held, mixed, MID_NAMES.lower(), MID_NAMES.upper()]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, WORD_PROBLEM), (2, MID_NAMES)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_contaminated(frame, bench).collect()}
    assert set(got) == {*((k, 1) for k in range(len(held))), (7, 2), (8, 2)}
    assert [got[k, 1].reparameterised for k in range(len(held))] == [True] * 4 + [False] * 2
    assert all(r.coverage == 1.0 and r.n_windows == (20 if r.item_id == 1 else 17) for r in got.values())


def test_slots_must_be_consistent():
    w = lambda place, item, doc: {"place": place, "pairs": [{"item": item, "doc": doc}]}
    got = decontaminate.judge_alignment([w(0, 1, 5), w(1, 1, 5), w(2, 1, 6), w(3, 2, 7)])
    assert got == {"places": [0, 1, 3], "run": 2, "changed": True}


def test_verbatim_items_are_all_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r.text for r in bench.collect()]
    holding = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    assert holding <= {r.doc_id for r in decontaminate.find_contaminated(docs, bench).collect()}


def test_pipeline_stages_keep_their_word(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert len(set(good) & set(ids)) > 0.75 * len(good)
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
