"""Helpers shared by the operators of this subpackage.

Executor-side helpers here stay small: they turn Arrow columns of texts into
word codes, and look words up in a per-worker table of bounded size.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.session import shared_root

#: Texts of one Arrow batch are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Words of a generation of a worker's word table; it holds two, and the words of one slice.
WORD_TABLE = 150_000


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library: unless PYTHONPATH names its
    folder already, hand it to Spark as a zip, once per Spark context."""
    home = Path(__file__).resolve().parents[2]
    if any(p and Path(p).resolve() == home for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    sc = spark.sparkContext
    if getattr(sc, "_cadence_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-py-"), "cadence.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((home / "cadence").rglob("*.py")):
            z.write(f, f.relative_to(home))
    sc.addPyFile(path)
    sc._cadence_shipped = True


#: Bytes of an Arrow batch, and of a Parquet row group, where whole texts are written between stages.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "parquet.block.size": str(32 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Set SMALL_BATCHES for the session where nothing is set: stages that read,
    work on and write whole texts at once hold fewer of them in memory."""
    for key, value in SMALL_BATCHES.items():
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"_{stem}_{k}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32(doc_id as text) mod 5 = 0.

    A null id counts as held out: nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the dense 0-based position of every row in the order of ``order``.

    A range shuffle sorts the rows over the cluster; one row per partition (its
    size) is summed up and joined back. The sorted rows are checkpointed first,
    so that positions survive a lost executor. Rows equal in all order columns
    get distinct positions in any order.
    """
    part, at = spare_name(df, "part"), spare_name(df, "at")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    rows = materialise(rows)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = spare_name(df, "start")
    starts = rows.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    # one row per partition: the number of shuffle partitions bounds what is broadcast
    joined = rows.join(F.broadcast(starts), part)
    return joined.withColumn(name, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, at, start)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterable[pa.Array]:
    """Cut a column of texts into runs of about ``most`` bytes (at least one row each)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def as_texts(column: pa.Array) -> pa.Array:
    """The column as large strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


class WordTable:
    """Values of words, worked out in lists by ``work`` and kept up to a bound.

    Words are kept in two generations: when the young one holds ``most`` words
    it becomes the old one, and words of the old one that are met again move
    over. Looking up never depends on what is kept: a forgotten word is worked
    out again.
    """

    def __init__(self, work: Callable[[list[str]], list], most: int = WORD_TABLE) -> None:
        self.work, self.most, self.young, self.old = work, most, {}, {}

    def values(self, words: list[str]) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, words))
        if None in out:
            holes = [k for k, x in enumerate(out) if x is None]
            missing = dict.fromkeys([words[k] for k in holes])
            if old:
                met = {w: old[w] for w in missing if w in old}
                young.update(met)
                missing = [w for w in missing if w not in met]
            if missing:
                missing = list(missing)
                young.update(zip(missing, self.work(missing), strict=True))
            for k in holes:
                out[k] = young[words[k]]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


_WORKER_TABLE: dict[tuple, WordTable] = {}


def worker_table(key: tuple, make: Callable[[], WordTable]) -> WordTable:
    """The worker process's word table of that key. A worker serves one operator
    after another: it keeps the table of the last one only, and hands memory of
    the one before back."""
    if key not in _WORKER_TABLE:
        _WORKER_TABLE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _WORKER_TABLE[key] = make()
    return _WORKER_TABLE[key]


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``; nodes are longs.

    Alternates the two contraction steps known as large-star and small-star:
    every node hands its neighbours its smallest neighbour. The neighbours of a
    node are never gathered: minima are aggregated map-side and joined back, so
    a node with very many links is split like any skewed join key. Each round is
    checkpointed; the number of rounds grows with the logarithm of the longest
    path. Nodes without links do not appear.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(u != v)
    now = materialise(now.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def hand_over(pairs: DataFrame, keep: Column) -> DataFrame:
        """Links (neighbour, smallest neighbour) for the neighbours that ``keep`` names."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").where(keep).select(v.alias("u"), F.col("m").alias("v")).where(u != v), least

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(v.alias("u"), u.alias("v")))
        large, _ = hand_over(both, v > u)
        large = large.distinct()
        # small star: links point down already
        down = large.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
        small, least = hand_over(down, v <= u)
        now = materialise(small.union(least.select("u", F.col("m").alias("v")).where(u != v)).distinct())
        then, seen = seen, mark(now)
        if then == seen:
            break
    members = now.select(u.alias("node"), v.alias("component"))
    return members.union(members.select("component", "component")).distinct()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts (large strings, no nulls) cut at single spaces: offsets of each
    text's words, the words as codes, and the distinct words the codes stand for."""
    words = pc.split_pattern(texts, " ")
    offsets = np.asarray(words.offsets)
    coded = words.flatten().dictionary_encode()
    return offsets - (offsets[0] if len(offsets) else 0), np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def joined_values(codes: np.ndarray, offsets: np.ndarray, values: list[bytes], unit: str = "u1") -> tuple[bytes, np.ndarray]:
    """The values of coded words strung together, and the byte offsets of each text
    in them. Values are moved in units of that type, which their sizes are multiples of."""
    kind = np.dtype(unit)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // kind.itemsize
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate(([0], np.cumsum(sizes[codes]))) if len(codes) else np.zeros(1, dtype=np.int64)
    here = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], sizes[codes])
    return np.frombuffer(b"".join(values), dtype=kind)[here].tobytes(), ends[offsets] * kind.itemsize
