"""Token ids in training order, as binary shards of fixed stride.

Documents are encoded, joined by an end-of-text id and cut into sequences of
equal length. A keyed Feistel permutation of a fixed domain, cycle-walked into
it, gives each sequence its global slot key; the keys are uniform, so equal
ranges of them are equal shards, and each range is sorted and written by one
task as one file. The dense slot of a sequence is its rank among all keys: the
shard's first slot, which follows from the sizes of the files before it, plus
its place in the file.

One pass encodes, one shuffle moves the ids. The permuted domain is the (unit,
place) numbers of sequences rather than 0..n-1: n is known only after all texts
are encoded, and counting first would encode everything twice.

Record: 8 bytes sequence number, 2 bytes number of ids (both big-endian), the
ids as little-endian 16-bit numbers (end-of-text ids fill up), a line feed. All
records have the same length, so a reader finds any slot by arithmetic and
resumes anywhere. Files are written by Spark's text writer (a record is a line
that may hold any bytes), so its commit protocol holds and any store works.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.common import WordTable, as_texts, coded_words, joined_values, ship_package, text_slices, worker_table

RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
SEQUENCE = 1024
#: Sequences of one unit (partition of the input), and all units: the domain.
PER_UNIT, DOMAIN = 10**9, 10**15
HEADER = 10
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts whose words cannot be encoded apart: a space beside white space or an edge.
_IRREGULAR = rf"^$|^{_SPACE}|{_SPACE}$| {_SPACE}|{_SPACE} "


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoding(path: str):
    """The library's byte-level BPE, one per worker process and file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_of(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u2").tobytes()


@functools.cache
def _starts_word(path: str) -> np.ndarray:
    """Which ids stand for bytes that begin with a space."""
    enc = encoding(path)
    starts = np.zeros(1 << 16, dtype=bool)
    for k, token in enumerate(enc.token_byte_values()):
        starts[enc.encode_single_token(token)] = token.startswith(b" ")
    return starts


def _words(path: str) -> WordTable:
    enc, starts = encoding(path), _starts_word(path)

    def work(words: list[str]) -> list[bytes]:
        # words as one text: each begins with the only space it has
        ids = np.array(enc.encode_ordinary("".join([" " + w for w in words])), dtype="<u2")
        cuts = [*(2 * np.flatnonzero(starts[ids])).tolist(), 2 * len(ids)]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return worker_table(("ids", path), lambda: WordTable(work))


def encode_slice(texts: pa.Array, path: str) -> list[bytes]:
    """The ids of each text of a slice (large strings, no nulls), as the library gives them."""
    enc = encoding(path)
    odd = np.asarray(pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False), dtype=bool)
    plain = texts.filter(pa.array(~odd))
    offsets, codes, words = coded_words(plain)
    data, ends = joined_values(codes, offsets, _words(path).values(words), "<u2")
    rare = iter([_bytes_of(enc.encode_ordinary(t)) for t in texts.filter(pa.array(odd)).to_pylist()])
    out: list[bytes] = []
    # the first word has no space in front: encoded anew without it
    table = _words(path).values
    cuts = zip(ends[:-1].tolist(), ends[1:].tolist(), codes[offsets[:-1]].tolist() if len(plain) else [], strict=True)
    heads: dict[int, tuple[int, bytes]] = {}
    for is_odd in odd.tolist():
        if is_odd:
            out.append(next(rare))
            continue
        a, b, code = next(cuts)
        if code not in heads:
            heads[code] = (len(table([words[code]])[0]), _bytes_of(enc.encode_ordinary(words[code])))
        skip, head = heads[code]
        out.append(head + data[a + skip : b])
    return out


def _cut(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(numbers, counts of ids, ids) of the sequences of a partition's texts, slice by slice."""
    size, end = 2 * length, _bytes_of([END_OF_TEXT])
    number, rest = TaskContext.get().partitionId() * PER_UNIT, b""
    for batch in batches:
        for part in text_slices(as_texts(batch.column(0))):
            data = rest + b"".join([t + end for t in encode_slice(part, path)])
            full = len(data) // size
            rest = data[full * size :]
            yield np.arange(number, number + full), np.full(full, length), [data[k * size : (k + 1) * size] for k in range(full)]
            number += full
    if rest:
        yield np.array([number]), np.array([len(rest) // 2]), [rest + end * (length - len(rest) // 2)]


def sequences(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """(number long, n_ids int, ids binary): sequences of ``length`` ids.

    The documents of a partition are strung together, each followed by an
    end-of-text id, and cut; the last sequence of a partition is filled up.
    ``number`` is partition times PER_UNIT plus place, so a task that runs again
    over the same rows in the same order makes the same sequences. Null and
    empty texts give an end-of-text id alone."""
    ship_package(docs.sparkSession)
    ranks = path or ranks_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, n, ids in _cut(batches, ranks, length):
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["number", "n_ids", "ids"])

    return docs.select("text").mapInArrow(rows, "number long, n_ids int, ids binary")


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing of numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, key: int, domain: int = DOMAIN, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..domain-1: a balanced Feistel network over the
    next even number of bits, walked along its cycle until it is back in the
    domain (fewer than four steps on average). ``inverse`` undoes it."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    h = np.uint64(half)
    order = range(rounds - 1, -1, -1) if inverse else range(rounds)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> h, x & low
        for r in order:
            round_key = (key * 0x100000001B3 + r * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
            if inverse:
                a, b = b ^ (_mix(a, round_key) & low), a
            else:
                a, b = b, a ^ (_mix(b, round_key) & low)
        return (a << h) | b

    x = np.asarray(numbers).astype(np.uint64)
    if len(x) and int(x.max()) >= domain:
        raise ValueError("number outside the domain")
    out = once(x)
    while len(far := np.flatnonzero(out >= np.uint64(domain))):
        out[far] = once(out[far])
    return out.astype(np.int64)


def write_training_order(docs: DataFrame, folder: str, key: int, shards: int | None = None, length: int = SEQUENCE, path: str | None = None) -> str:
    """Write the sequences of ``docs`` to ``folder`` in the order of ``key``.

    ``shards`` equal ranges of slot keys make a file each (default: the number
    of shuffle partitions). The same rows, partitions and key give the same
    files. Nulls in other columns, repeated rows and other columns play no part;
    an empty table writes a folder without records. Returns ``folder``.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = -(-DOMAIN // shards)

    ranks = path or ranks_path()
    ship_package(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, n, ids in _cut(batches, ranks, length):
            slot_key = permute(number, key)
            head = np.concatenate([number.astype(">i8").view(np.uint8).reshape(-1, 8), n.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
            records = [h.tobytes() + x for h, x in zip(head, ids, strict=True)]
            shard = (slot_key // width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot_key), pa.array(records, pa.binary())], ["shard", "slot_key", "record"])

    placed = docs.select("text").mapInArrow(place, "shard int, slot_key long, record binary")
    ranged = placed.repartitionById(shards, "shard").sortWithinPartitions("slot_key")
    ranged.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)
    return folder


def stride(length: int = SEQUENCE) -> int:
    return HEADER + 2 * length + 1


def manifest(spark: SparkSession, folder: str, length: int = SEQUENCE) -> DataFrame:
    """(shard, path, first_slot, n_sequences) of a written folder, from file sizes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    sized = files.select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", (F.col("length") / stride(length)).cast("long").alias("n_sequences")
    )
    # one row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("first_slot", F.coalesce(F.sum("n_sequences").over(before), F.lit(0))).select("shard", "path", "first_slot", "n_sequences")


def read_training_order(spark: SparkSession, folder: str, start: int = 0, length: int = SEQUENCE) -> DataFrame:
    """(slot, shard, number, n_ids, ids binary) of all sequences from slot ``start`` on.

    Files that end before ``start`` are not read."""
    table = manifest(spark, folder, length).where(F.col("first_slot") + F.col("n_sequences") > start)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    step = stride(length)
    # one row per file
    rows = content.join(F.broadcast(table), "path").withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), start - F.col("first_slot")).cast("int"), (F.col("n_sequences") - 1).cast("int"))))
    rows = rows.select((F.col("first_slot") + F.col("k")).alias("slot"), "shard", F.substring("content", F.col("k") * step + 1, F.lit(step - 1)).alias("r"))
    number = F.conv(F.hex(F.substring("r", 1, 8)), 16, 10).cast("long")
    n_ids = F.conv(F.hex(F.substring("r", 9, 2)), 16, 10).cast("int")
    return rows.select("slot", "shard", number.alias("number"), n_ids.alias("n_ids"), F.substring("r", F.lit(HEADER + 1), n_ids * 2).alias("ids"))
