"""The registered queries of this subpackage, each over whole tables, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import chat, conversation_repair, curves, decontaminate, oracle, quality, secrets, simhash, spelling, spm_codec, suffix_dedup, token_counts, toxicity, training_order
from cadence.llm.common import read_table
from cadence.session import shared_dir

#: Key of the training order that the query writes.
ORDER_KEY = 20_240_607


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), quality.fit_from_tables(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), toxicity.fit_from_tables(spark, sf_dir))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 100."""
    return curves.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the probe rows as an expression: a list from the driver would start a Python worker
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(turns.columns, row, strict=True)]) for row in chat.PROBE])
    probe = spark.range(1).select(F.inline(rows)).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.conversation_digests(chat.format_whole_conversations(turns.unionByName(probe)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_codec.encode_documents(read_table(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards to a new folder below the shared one, then read every
    sequence back: slot, shard, number, n_ids, ids_sha256."""
    folder = training_order.write_training_order(read_table(spark, sf_dir, "documents"), shared_dir(spark, "training-order"), ORDER_KEY)
    back = training_order.read_training_order(spark, folder)
    return back.select("slot", "shard", "number", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def damaged_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; null roles and texts one space) as the
    contract damages them, by crc32 of ``conv_id:turn`` modulo 20."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.where(F.col("hit") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, its rows damaged by the contract, audited and repaired."""
    turns = read_table(spark, sf_dir, "conversations")
    rows, report = conversation_repair.repair(damaged_conversations(turns))
    audits = conversation_repair.conversation_audits(rows).withColumnRenamed("conv", "c")
    every = turns.select("conv_id").distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(audits, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(b""), 256)
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs and the digest of what is left."""
    rows = suffix_dedup.repeated_strings(read_table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return rows.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: One of so many runs loses a code point before words are counted.
GARBLE = 97


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose crc32 of ``doc_id:run`` GARBLE divides lose the code point at
    crc32 % length; words of 5 code points and 3 occurrences are grouped."""
    # a shorter run cannot become a word
    runs = spelling.word_runs(read_table(spark, sf_dir, "documents"), least=5)
    h = F.crc32(F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    damaged = runs.select(F.when(F.col("h") % GARBLE == 0, short).otherwise(F.col("run")).alias("run"))
    return spelling.spelling_variants(spelling.count_words(damaged))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_secret_scan, op3_token_counts, op4_toxicity, op5_hilbert_neighbours,
        op6_chat_format, op7_simhash, op8_sentencepiece, op9_training_order, op10_decontaminate,
        op11_conversation_repair, op12_suffix_dedup, op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.oracle_sql(),
        "op6_chat_format": chat.oracle_sql(),
        "op11_conversation_repair": oracle.conversation_repair_sql(),
        "op12_suffix_dedup": oracle.suffix_dedup_sql(),
        "op13_spelling_variants": oracle.spelling_sql(GARBLE),
    }
