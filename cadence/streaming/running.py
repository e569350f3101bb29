"""Structured Streaming forms of the incremental work.

* :func:`running_totals` -- sums and counts per key over files as they land,
  in any order. Every micro-batch adds the keys that it changed (update mode)
  as a folder of its own and then notes that the folder is whole; the result
  is the latest row of each key among whole folders. Nothing is overwritten,
  so a reader never meets a half-written result, and a batch that is run
  again writes the same folder. No watermark: a late row must still count.
  Once ``compact_every`` whole folders have gathered they are merged into a base
  folder, and a note makes the base count; folders that the base before it holds
  are removed then, so a reader that began with that base still finds what it needs.
* :func:`append_stream` -- landed pages appended to a Parquet table with
  exactly-once file-sink semantics.

Both keep their state and progress in a checkpoint folder on the shared file
system, so a lost executor or a restarted query resumes where it stopped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from cadence.operators.aggregate import exact_sum, measure, non_null
from cadence.sinks.writers import delete_folder, list_folders


def running_totals(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    keys: Mapping[str, Column],
    value: str,
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    scale: int | None = None,
    files_per_trigger: int | None = None,
    compact_every: int | None = 16,
) -> DataFrame:
    """Run the running aggregate over everything landed so far
    (``availableNow``), then return the result table (keys, s, n, rows).

    ``landing`` is a folder or a glob; the files are read where they are. With
    nothing landed yet the result is empty. Results in ``out`` belong to their
    ``checkpoint``: another checkpoint starts a result of its own."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(landing)
    key_names = list(keys)
    agg = (
        stream.select(*[c.alias(k) for k, c in keys.items()], measure(value).alias("v"))
        .where(non_null(key_names))
        .groupBy(*key_names)
        .agg(exact_sum("v", scale).alias("s"), F.count("v").alias("n"), F.count(F.lit(1)).alias("rows"))
    )

    own = f"{out.rstrip('/')}/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    # an empty first folder, so that the result has a table before any batch
    spark.createDataFrame([], agg.schema).write.mode("ignore").parquet(f"{own}/changed/epoch=-1")

    def add_changed(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/changed/epoch={epoch}")
        note = batch.sparkSession.range(1).select(F.lit(epoch).alias("epoch"))
        note.write.mode("overwrite").json(f"{own}/whole/epoch_{epoch}")

    query = (
        agg.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add_changed)
        .start()
    )
    query.awaitTermination()
    state = RunningState(spark, own, key_names, agg.schema)
    if compact_every and len(state.epochs_since_base()) >= compact_every:
        state.compact()
    return state.table()


class RunningState:
    """The folders of a running result:

        changed/epoch=7/      keys that batch 7 changed
        whole/epoch_7/        note: that folder is whole
        base/upto=5/          the latest rows of epochs up to 5
        whole_base/upto_5/    note: that base is whole, and counts

    A crash between any two steps leaves the state as it was, or as it shall be:
    a base counts only with its note, and nothing is removed that the last two
    bases or the epochs behind them need."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType) -> None:
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(int(n.removeprefix(prefix)) for n in list_folders(self.spark, f"{self.path}/{folder}") if n.startswith(prefix))

    def bases(self) -> list[int]:
        return self._numbers("whole_base", "upto_")

    def epochs_since_base(self) -> list[int]:
        """Whole epochs behind the last base."""
        last = max(self.bases(), default=-1)
        return [e for e in self._numbers("whole", "epoch_") if e > last]

    def table(self) -> DataFrame:
        """(keys, s, n, rows): the latest row of each key."""
        return self._latest().select(*self.keys, "last.s", "last.n", "last.rows")

    def _latest(self) -> DataFrame:
        base = max(self.bases(), default=None)
        stored = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])
        paths = [f"{self.path}/changed/epoch={e}" for e in self.epochs_since_base()]
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/changed").parquet(*paths, f"{self.path}/changed/epoch=-1")
        if base is not None:
            rows = rows.unionByName(self.spark.read.schema(stored).parquet(f"{self.path}/base/upto={base}"))
        return rows.groupBy(*self.keys).agg(F.max(F.struct("epoch", "s", "n", "rows")).alias("last"))

    def compact(self) -> int | None:
        """Merge the last base and the epochs behind it into a new base; then remove
        what only bases before the last one need. Returns the base's number."""
        epochs = self.epochs_since_base()
        if epochs:
            upto = epochs[-1]
            self._write_base(upto)
            self.spark.range(1).write.mode("overwrite").json(f"{self.path}/whole_base/upto_{upto}")
        self._remove_old()
        return max(self.bases(), default=None)

    def _write_base(self, upto: int) -> None:
        merged = self._latest().select(*self.keys, "last.s", "last.n", "last.rows", "last.epoch")
        merged.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")

    def _remove_old(self) -> None:
        bases = self.bases()
        if len(bases) < 2:
            return
        oldest = bases[-2]  # readers of this base need the epochs behind it
        for b in [b for b in bases if b < oldest]:
            delete_folder(self.spark, f"{self.path}/whole_base/upto_{b}")
        for b in [b for b in self._numbers("base", "upto=") if b < oldest]:
            delete_folder(self.spark, f"{self.path}/base/upto={b}")
        for e in [e for e in self._numbers("whole", "epoch_") if e <= oldest]:
            delete_folder(self.spark, f"{self.path}/whole/epoch_{e}")
        for e in [e for e in self._numbers("changed", "epoch=") if 0 <= e <= oldest]:
            delete_folder(self.spark, f"{self.path}/changed/epoch={e}")


def append_stream(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    transform,
    out: str,
    checkpoint: str,
    fmt: str = "json",
    files_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Append landed records (after ``transform``) to a Parquet table; run
    until everything landed is in, then return the table.

    ``options`` go to the reader: pages that are JSON arrays over several lines
    need ``multiLine``. A record that cannot be read fails the run instead of
    turning into an empty row (``mode`` FAILFAST, unless ``options`` say else)."""
    reader = spark.readStream.schema(schema).format(fmt).options(**{"mode": "FAILFAST", **(options or {})})
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = transform(reader.load(landing))
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)
