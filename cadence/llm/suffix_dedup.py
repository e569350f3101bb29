"""Repeated strings across documents by bucket-pointer refinement of sampled suffixes.

Wanted are all strings of 50 bytes that also start in a document with a smaller
id. Sorting the suffix at every byte would move many times the text, so suffixes
are sampled by a rule that depends on the text alone: of the 16-grams of a
50-byte window the least one (by a hash, the leftmost of equals) is its anchor. Equal windows
have equal anchors at equal places. Neighbouring windows share an anchor; such a
run is a cell, and cells are what is refined:

depth 16: buckets are the anchors' 16-grams. A bucket that one document only
    has is done; so is one whose cells all have the same text, for then the
    smallest document of the bucket covers the others.
depth 32: in the buckets left, bucket identifiers of later offsets are paired:
    that of the anchor and of 16 bytes on, or of 16 bytes before and the anchor
    (each window has one of the two pairs). Buckets of one document are done. So
    are cells whose whole text a smaller document has: they are covered, and that
    document stands for them further on.
depth 50: the windows left, under the pair of depth 32 identifiers at 0 and 18.

A bucket identifier is a hash of the pair of identifiers it comes from, so all
executors name buckets alike without a common numbering, and each depth is worked
out from the ones before. Decisions are taken on two identifiers, 128 bits.

At each depth a slice of documents (about ``SLICE_BYTES``) sends every bucket
once, with its smallest document and whether it has several, however often it has the bucket; buckets are
dealt out by their identifiers and sorted there, and what comes back is one byte
for a bucket: is a smaller document elsewhere, another one, another text. So a
passage that a third of all documents share costs one entry a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import as_texts, materialise, ship_package, text_slices
from cadence.session import shared_dir

#: Length of a repeated string, and of the grams that make the first buckets.
LENGTH, GRAM = 50, 16
#: The windows of an anchor's later half have the gram pair that begins at the anchor.
_AHEAD = LENGTH - 2 * GRAM
#: Documents of about so many bytes make a slice; a longer document makes one of its own.
SLICE_BYTES = 2 << 20
#: Window starts worked on at once, whatever the length of a document.
PIECE = 1 << 18
#: Bytes of entries that one group sorts, about.
GROUP_BYTES = 16 << 20
_SMALLER, _OTHER, _VARIED = 1, 2, 4
_NO_ID = np.iinfo(np.int64).max


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket identifiers of pairs of bucket identifiers."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    y = b * np.uint64(0xC2B2AE3D27D4EB4F)
    y ^= y >> np.uint64(29)
    x += y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as numbers."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


def _deeper(names: np.ndarray, step: int) -> np.ndarray:
    return _mixed(names[:-step], names[step:])


def window_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Depth 50 identifiers of the windows that start at the places ``at``."""
    eights = _eights(data)

    def sixteen(p: np.ndarray) -> np.ndarray:
        return _mixed(eights[p], eights[p + 8])

    def thirty_two(p: np.ndarray) -> np.ndarray:
        return _mixed(sixteen(p), sixteen(p + GRAM))

    return _mixed(thirty_two(at), thirty_two(at + _AHEAD))


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least gram among ``width`` in a row, for every start."""
    least, place, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    return place


class Slice:
    """The documents of a slice in the order of their ids, strung together, and
    the cells of all their windows: first and last window start, anchor place,
    document, gram bucket and the identifier of the cell's whole text."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes) -> None:
        self.ids, self.data = ids, np.frombuffer(data, dtype=np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        parts = [self._cells(at, min(at + PIECE, len(data) - LENGTH + 1)) for at in range(0, max(0, len(data) - LENGTH + 1), PIECE)]
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.first, self.last, self.anchor, self.doc, self.gram, self.text = (
            np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]) for k, kind in enumerate(kinds)
        )

    def _cells(self, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """The cells of the windows that start at begin to end - 1."""
        data = self.data[begin : end + LENGTH - 1]
        eights = _eights(data)
        grams = _deeper(eights, 8)
        full = _deeper(_deeper(grams, GRAM), _AHEAD)
        place = anchors(grams, LENGTH - GRAM + 1)
        inside = np.clip(self.starts, begin, end)
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(inside))
        whole = self.starts[1:][doc] - np.arange(begin, end) >= LENGTH
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
        stop = whole.copy()
        stop[:-1] &= ~whole[1:] | (place[1:] != place[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        anchor = place[first].astype(np.int64)
        shape = (((anchor - first) << 8) | (last - first)).astype(np.uint64)
        text = _mixed(_mixed(full[first], full[last]), shape + np.uint64(1))
        return first + begin, last + begin, anchor + begin, doc[first], grams[anchor], text


class Buckets:
    """The distinct buckets of some items of a slice: each bucket once, with the
    smallest document, in the order in which they are sent."""

    def __init__(self, doc: np.ndarray, ids: np.ndarray, parts: int, name: np.ndarray, text: np.ndarray, by_both: bool) -> None:
        keys = (text, name) if by_both else (name,)
        order = np.lexsort(keys)
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        group = np.cumsum(new) - 1
        self.of = np.empty(len(order), dtype=np.int64)  # the bucket of each item
        self.of[order] = group
        head = order[new]  # sorting is stable: the item of the smallest document
        count = len(head)
        varied = np.zeros(count, dtype=bool)
        varied[group[text[order] != text[head][group]]] = True
        self.least = ids[doc[head]]
        most = np.full(count, np.iinfo(np.int64).min)
        np.maximum.at(most, self.of, ids[doc])
        self.many = most != self.least
        name, text = name[head], np.where(varied, np.uint64(0), text[head])
        part = (name % np.uint64(parts)).astype(np.int64)
        self.order = np.lexsort((head, part))
        self.name, self.text, self.part = name[self.order], text[self.order], part[self.order]
        self.smallest, self.has_many = self.least[self.order], self.many[self.order].astype(np.uint8)

    def rows(self, number: int) -> Iterator[dict]:
        """One row for each part that has buckets."""
        cuts = np.flatnonzero(np.concatenate(([True], self.part[1:] != self.part[:-1], [True]))) if len(self.part) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield {"part": int(self.part[a]), "slice": number, "name": self.name[a:b].tobytes(), "text": self.text[a:b].tobytes(), "least": self.smallest[a:b].tobytes(), "many": self.has_many[a:b].tobytes()}

    def answered(self, replies: list[dict] | None) -> np.ndarray:
        """What came back, for every bucket."""
        got = sorted(replies or [], key=lambda r: r["part"])
        flags = np.frombuffer(b"".join(r["flags"] for r in got), dtype=np.uint8)
        if len(flags) != len(self.order):
            raise ValueError("replies do not fit the slice")
        out = np.empty(len(flags), dtype=np.uint8)
        out[self.order] = flags
        return out


def answer(name: np.ndarray, text: np.ndarray, least: np.ndarray, many: np.ndarray, by_both: bool) -> np.ndarray:
    """For entries of all slices (``many``: the slice has several documents of the
    bucket): is there a smaller document in the bucket, another one, another text."""
    keys = (least, text, name) if by_both else (least, name)
    order = np.lexsort(keys)
    n, t, d = name[order], text[order], least[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = (n[1:] != n[:-1]) | ((t[1:] != t[:-1]) if by_both else False)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    smallest = d[starts]
    other = (np.maximum.reduceat(d, starts) != smallest) | (np.maximum.reduceat(many[order], starts) > 0)
    varied = np.zeros(len(starts), dtype=bool)
    varied[group[(t != t[starts][group]) | (t == 0)]] = True
    flags = (d > smallest[group]) * _SMALLER + other[group] * _OTHER + varied[group] * _VARIED
    out = np.empty(len(n), dtype=np.uint8)
    out[order] = flags
    return out


class Refinement:
    """The depths of one slice, each from the replies to the ones before."""

    def __init__(self, row: Slice, parts: int, replies: list[list[dict] | None]) -> None:
        self.row, self.parts = row, parts
        self.covered: list[tuple[np.ndarray, np.ndarray]] = []
        self.buckets = self._depth_16()
        for flags, go_on in zip(replies, (self._depth_32, self._depth_50, self._end), strict=False):
            self.buckets = go_on(self.buckets.answered(flags))

    def _named(self, doc: np.ndarray, name: np.ndarray, text: np.ndarray, by_both: bool = False) -> Buckets:
        return Buckets(doc, self.row.ids, self.parts, name, text, by_both)

    def _depth_16(self) -> Buckets:
        row = self.row
        return self._named(row.doc, row.gram, row.text)

    def _depth_32(self, flags: np.ndarray) -> Buckets:
        row, b = self.row, self.buckets
        of = flags[b.of]
        varied = of & _VARIED > 0
        smaller = (of & _SMALLER > 0) | (row.ids[row.doc] > b.least[b.of])
        done = ~varied & smaller
        self.covered.append((row.first[done], row.last[done]))
        open_cells = np.flatnonzero(varied & ((of & _OTHER > 0) | b.many[b.of]))
        first, last, anchor = row.first[open_cells], row.last[open_cells], row.anchor[open_cells]
        # windows up to `turn` have the pair before the anchor, later ones the pair from it on
        turn = anchor - _AHEAD
        before, after = first < turn, last >= turn
        self.cell = np.concatenate([open_cells[before], open_cells[after]])
        self.window_first = np.concatenate([first[before], np.maximum(first, turn)[after]])
        self.window_last = np.concatenate([np.minimum(last, turn - 1)[before], last[after]])
        eights = _eights(row.data)

        def pair(at: np.ndarray) -> np.ndarray:
            return _mixed(_mixed(eights[at], eights[at + 8]), _mixed(eights[at + GRAM], eights[at + GRAM + 8]))

        # whole cells too: a copy of a smaller document's cell needs no depth 50
        self.open_cells = open_cells
        text = row.text[open_cells]
        name = np.concatenate([pair(anchor[before] - GRAM) ^ np.uint64(1), pair(anchor[after]), _mixed(row.gram[open_cells], text) ^ np.uint64(2)])
        text = np.concatenate([np.ones(len(self.cell), dtype=np.uint64), text])
        return self._named(row.doc[np.concatenate([self.cell, open_cells])], name, text)

    def _depth_50(self, flags: np.ndarray) -> Buckets:
        row, b = self.row, self.buckets
        pairs = b.of[: len(self.cell)]
        cells = b.of[len(self.cell) :]
        copied = (flags[cells] & _SMALLER > 0) | (row.ids[row.doc[self.open_cells]] > b.least[cells])
        copied = self.open_cells[copied & (flags[cells] & _VARIED == 0)]
        self.covered.append((row.first[copied], row.last[copied]))
        is_copy = np.zeros(len(row.first), dtype=bool)
        is_copy[copied] = True
        left = np.flatnonzero(((flags[pairs] & _OTHER > 0) | b.many[pairs]) & ~is_copy[self.cell])
        first, count = self.window_first[left], self.window_last[left] - self.window_first[left] + 1
        skipped = np.cumsum(count) - count
        self.window = np.repeat(first - skipped, count) + np.arange(int(count.sum()))
        cell = np.repeat(self.cell[left], count)
        order = np.argsort(self.window, kind="stable")  # documents stay in the order of their ids
        self.window, cell = self.window[order], cell[order]
        self.window_doc = row.doc[cell]
        return self._named(self.window_doc, window_names(row.data, self.window), row.gram[cell], by_both=True)

    def _end(self, flags: np.ndarray) -> Buckets:
        b = self.buckets
        smaller = (flags[b.of] & _SMALLER > 0) | (self.row.ids[self.window_doc] > b.least[b.of])
        self.covered.append((self.window[smaller], self.window[smaller]))
        return b

    def removed(self) -> np.ndarray:
        """Which bytes of the slice go."""
        change = np.zeros(len(self.row.data) + 1, dtype=np.int32)
        for first, last in self.covered:
            np.add.at(change, first, 1)
            np.subtract.at(change, last + LENGTH, 1)
        return np.cumsum(change[:-1]) > 0


_SLICES = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_ENTRIES = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("name", pa.binary()), ("text", pa.binary()), ("least", pa.binary()), ("many", pa.binary())])
_REPLIES = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("flags", pa.binary())])
_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the order they come in, cut into slices; a slice's documents by id, nulls last."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts, at = as_texts(batch.column(1)), 0
        for part in text_slices(texts, SLICE_BYTES):
            ids = batch.column(0).slice(at, len(part)).to_pylist()
            data = [t.as_buffer().to_pybytes() for t in part.cast(pa.large_binary())]
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            packed = zstandard.compress(b"".join([data[k] for k in order]), 3)
            yield pa.RecordBatch.from_pylist([{"slice": number, "ids": [ids[k] for k in order], "sizes": [len(data[k]) for k in order], "data": packed}], schema=_SLICES)
            number, at = number + 1, at + len(part)


def _unpacked(batch: pa.RecordBatch, depths: int) -> Iterator[tuple[int, list, Slice, list]]:
    """The slices of a batch with the replies they have had."""
    for r in batch.to_pylist():
        ids = np.array([_NO_ID if i is None else i for i in r["ids"]], dtype=np.int64)
        data = zstandard.decompress(r["data"])
        yield r["slice"], r["ids"], Slice(ids, np.array(r["sizes"], dtype=np.int64), data), [r[f"replies_{k}"] for k in range(depths)]


def _sent(slices: DataFrame, depth: int, parts: int) -> DataFrame:
    """The entries that the slices send at a depth (0, 1, 2), replies to the earlier ones at hand."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for number, _, row, replies in _unpacked(batch.slice(at, 1), depth):
                    yield pa.RecordBatch.from_pylist(list(Refinement(row, parts, replies).buckets.rows(number)), schema=_ENTRIES)

    return slices.mapInArrow(rows, "part long, slice long, name binary, text binary, least binary, many binary")


def _replies(entries: DataFrame, depth: int) -> DataFrame:
    """(slice, replies_<depth>): the buckets of each part sorted, and answers for every slice."""

    def judge(group: pa.Table) -> pa.Table:
        joined = {c: b"".join(group.column(c).to_pylist()) for c in ("name", "text", "least", "many")}
        name, text = (np.frombuffer(joined[c], dtype=np.uint64) for c in ("name", "text"))
        flags = answer(name, text, np.frombuffer(joined["least"], dtype=np.int64), np.frombuffer(joined["many"], dtype=np.uint8), by_both=depth == 2).tobytes()
        ends = np.cumsum([len(x) // 8 for x in group.column("name").to_pylist()]).tolist()
        cut = [flags[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table([group.column("slice"), group.column("part"), pa.array(cut, pa.binary())], schema=_REPLIES)

    judged = entries.groupBy("part").applyInArrow(judge, "slice long, part long, flags binary")
    # a slice gets one byte for each of its own buckets
    return judged.groupBy("slice").agg(F.collect_list(F.struct("part", "flags")).alias(f"replies_{depth}"))


def _dealt_out(packed: DataFrame) -> DataFrame:
    """A checkpoint of the slices, dealt out by their numbers. Adaptive execution is
    off while it is planned: an adaptive plan does not tell its partitioning."""
    spark = packed.sparkSession
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return materialise(packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice"))
    finally:
        spark.conf.set(key, before)


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs``.

    ``spans`` are the maximal runs of bytes of the UTF-8 text that strings of
    LENGTH bytes cover which also start in a document with a smaller id, in order;
    ``kept`` is the text without them (bytes: a run may cut a character). Strings
    never cross documents, overlaps count, and strings are judged on the texts as
    they came in.

    Null and empty texts, and texts shorter than LENGTH, lose nothing. Rows of
    one id are the same document: they take nothing from one another. A null id
    counts as larger than all others, so such rows lose what any document with an
    id has, and nothing to each other. Repeated rows come back as often as they
    stand in the input. A text of any length is worked on whole, PIECE windows at
    a time. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = shared_dir(spark, "repeats")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = named.mapInArrow(_pack, "slice long, ids array<long>, sizes array<long>, data binary")
    # the checkpoint keeps the partitioning: joins with replies move the replies only
    slices = _dealt_out(packed)
    total = slices.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    # an anchor every 17 or 18 bytes, three numbers of 8 bytes each
    parts = 1 + int(total * 24 // (GROUP_BYTES * (LENGTH - GRAM + 2) // 2))
    known = slices
    for depth in range(3):
        at = f"{folder}/{depth}"
        _replies(_sent(known, depth, parts), depth).write.parquet(at)
        known = known.join(spark.read.parquet(at), "slice", "left")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):
                for _, ids, row, replies in _unpacked(batch.slice(at, 1), 3):
                    gone = Refinement(row, parts, replies).removed()
                    out = []
                    for doc_id, a, b in zip(ids, row.starts[:-1].tolist(), row.starts[1:].tolist(), strict=True):
                        mine = gone[a:b]
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                        spans = [{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                        out.append({"doc_id": doc_id, "n_bytes": b - a, "spans": spans, "kept": row.data[a:b][~mine].tobytes()})
                    yield pa.RecordBatch.from_pylist(out, schema=kind)

    return known.mapInArrow(results, _RESULT)
