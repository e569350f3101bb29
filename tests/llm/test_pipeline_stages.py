"""Each stage of the pipeline against its operator's brute force, on odd rows and tables."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadence.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents of sf0.001 with nulls, empty texts, repeats, a null id and clashing columns."""
    root = tmp_path_factory.mktemp("pipeline")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", root / f"{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(3)
    odd = spark.createDataFrame(
        [(900_001, None), (900_002, ""), (900_003, " \n "), (None, "no id here, only words and more words"), (900_004, "word " * 20_000)], "doc_id long, text string"
    ).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    every = docs.unionByName(first).unionByName(odd)
    for name in ("fp", "best_id", "score", "bad_id", "id", "rank"):
        every = every.withColumn(name, F.lit("x"))
    every.write.parquet(f"{root}/documents.parquet")
    return str(root)


def run_stage(spark, k, docs, sf_dir):
    return corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_quality_stage_keeps_what_the_score_keeps(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = run_stage(spark, 0, docs, tables)
    assert kept.columns == docs.columns
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit_from_tables(spark, tables))
    assert ids(kept) == ids(scored.where("predicted = 1"))


def test_simhash_stage_keeps_one_of_each_group(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = run_stage(spark, 1, docs, tables)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], simhash.text_fingerprint((r["text"] or "").encode(), 3)) for r in docs.select("doc_id", "text").collect()]
    prints = sorted({fp for _, fp in rows})
    group = {fp: fp for fp in prints}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:  # every pair of fingerprints
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                group[top(a)] = top(b)
    least = {}
    for i, fp in rows:
        key = (i is None, i or 0)
        least[top(fp)] = min(least.get(top(fp), key), key)
    assert ids(kept) == sorted((not none, i) for none, i in least.values())


def test_decontamination_stage_drops_what_the_operator_finds(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = run_stage(spark, 2, docs, tables)
    found = decontaminate.find_contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{tables}/benchmark.parquet"))
    gone = {r["doc_id"] for r in found.collect()}
    assert gone and ids(kept) == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.select("doc_id").collect() if r["doc_id"] not in gone)


def test_last_stages_keep_every_document(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    redacted = run_stage(spark, 3, docs, tables)
    assert redacted.columns == docs.columns and ids(redacted) == ids(docs)
    coded = run_stage(spark, 4, docs, tables)
    assert ids(coded) == ids(docs) and {"doc_id", "n_tokens", "ids"} <= set(coded.columns)


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for k in range(len(corpus_pipeline.STAGES)):
        assert run_stage(spark, k, docs, tables).count() == 0


def test_whole_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    n = out.count()
    assert 0 < n < spark.read.parquet(f"{tables}/documents.parquet").count()
    assert out.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
