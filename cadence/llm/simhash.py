"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code of 64 bits: the perfect Hamming
code on bits 1 to 63 (covering radius 1) times the free bit 0. Two fingerprints
that differ in at most ``max_distance`` (2 or less) bits have a midpoint one
bit or less from both, and an anchor within the covering radius of that
midpoint; so both reach that anchor within covering radius plus half the
threshold. Every fingerprint is therefore copied to all anchors within
1 + 1 = 2 bits: 33 of them (2 if it lies on an anchor). Measuring the threshold
from the midpoint instead of from one of the two keeps the copies at 33; from
one side (radius 1 + 2) they would be over 600.

Fingerprints are made distinct first, so one anchor receives at most the 2,081
fingerprints of a 64-bit ball of radius 2, however many documents there are:
the group compared per anchor has a proven bound and no key can be hot. Per
anchor only the links of a spanning forest go on, which join the same
documents as all pairs would.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import as_texts, connected_components, materialise, ship_package, spare_name, text_slices

SEED = 42
#: Hashes voted on at once; longer texts go on block by block.
VOTE_BLOCK = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_fingerprint(data: bytes, shingle: int) -> int:
    """SimHash of one UTF-8 text: A-Z lower-cased, words cut at space and
    \\x09-\\x0D, shingles of ``shingle`` words with repeats, XXH64 (seed 42);
    a bit is set if it is set in over half the hashes. No word: zero."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, total, VOTE_BLOCK):
        part = words[at : at + VOTE_BLOCK + shingle - 1]
        pieces = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else (b" ".join(words),)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * votes > total).tolist()))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of a text as a signed long; null counts as empty."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        parts = (as_texts(part).cast(pa.large_binary()) for part in text_slices(texts))
        out = np.fromiter((text_fingerprint(x.as_py(), shingle) for part in parts for x in part), dtype=np.uint64, count=len(texts))
        return pa.array(out.view(np.int64))

    return of(text)


def anchors_within_two(bits: np.ndarray) -> list[np.ndarray]:
    """All anchors at 2 bits or less from each fingerprint (uint64).

    Bits 1 to 63 are numbered as in the Hamming code: the syndrome is the XOR
    of the numbers of the set bits, and names the bit that leads to the nearest
    code word. Code words at 2 bits flip i and i XOR syndrome.
    """
    places = np.arange(64, dtype=np.uint64)
    is_set = (bits[:, None] >> places) & np.uint64(1)
    syndrome = np.bitwise_xor.reduce(np.where(is_set.astype(bool), places, np.uint64(0)), axis=1)
    one = np.uint64(1)
    near = np.where(syndrome > 0, bits ^ (one << syndrome), bits)
    out = []
    for fp, s, home in zip(bits, syndrome, near, strict=True):
        if s:
            i = places[1:]
            j = i ^ s
            i, j = i[(i < j) & (j != 0)], j[(i < j) & (j != 0)]
            out.append(np.concatenate(([home, home ^ one], fp ^ (one << i) ^ (one << j))))
        else:
            out.append(np.array([home, home ^ one], dtype=np.uint64))
    return out


def _anchors(fp: str) -> Column:
    @arrow_udf("array<long>")
    def of(fps: pa.Array) -> pa.Array:
        rows = anchors_within_two(np.asarray(fps).astype(np.int64).view(np.uint64))
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))

    return of(F.col(fp))


def spanning_links(group: np.ndarray, most: int) -> list[dict]:
    """Links of a spanning forest of ``group`` (distinct uint64) under distance <= ``most``."""
    out, left = [], np.sort(group)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= most
            for x in left[near]:
                todo.append(x)
                out.append({"u": int(at.view(np.int64)), "v": int(x.view(np.int64))})
            left = left[~near]
    return out


def linked_fingerprints(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(u, v): links that connect the same distinct fingerprints (column ``fp``,
    no nulls) as all pairs at ``max_distance`` bits or less would."""
    if not 0 <= max_distance <= 2:
        raise ValueError("anchors within two bits cover distances of 0, 1 and 2")

    @arrow_udf("array<struct<u:long,v:long>>")
    def forest(groups: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))
        return pa.array([spanning_links(np.asarray(g.values).astype(np.int64).view(np.uint64), max_distance) for g in groups], type=kind)

    copies = fps.select("fp", F.explode(_anchors("fp")).alias("anchor"))
    # at most 2,081 distinct fingerprints lie within two bits of an anchor
    met = copies.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode(forest("fps")).alias("e")).select("e.u", "e.v").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int) -> DataFrame:
    """(id, fp, component, component_id) for every row; component names a class by a fingerprint."""
    ship_package(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp"))
    prints = materialise(prints)
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    parts = connected_components(linked_fingerprints(distinct, max_distance))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "component").select("fp", "component", "component_id")
    # the side of the documents may have a hot fingerprint; AQE splits it
    return prints.join(by_print, "fp").select("id", "fp", "component", "component_id")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    id among all documents reachable over fingerprints at ``max_distance`` bits
    or less, the document itself included.

    Null and empty texts, and texts of white space only, have fingerprint zero
    and link like any other. Rows with a null id take part in links; they are
    never the smallest id, and a component of null ids only has a null
    component_id. Repeated rows come back as often as they stand in the input.
    Empty input gives no rows. Other columns, whatever their names, are ignored.
    """
    rows = _components(docs, id_col, text_col, shingle, max_distance)
    return rows.select(F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the
    smallest doc_id. Where that id stands in several rows, the smallest
    fingerprint and then the first text decide (nulls first). A component whose
    ids are all null keeps one row likewise. All columns stay as they are."""
    fp, rank = spare_name(docs, "fp"), spare_name(docs, "rank")
    rows = _components(docs, "doc_id", "text", shingle, max_distance)
    copies = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
    chosen = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("fp").alias("best_fp"), F.min("id").alias("best_id"))
    chosen = materialise(chosen.join(copies, F.col("best_id").eqNullSafe(F.col("id"))).select("best_fp", "best_id", "n_rows"))
    once, often = chosen.where("n_rows = 1"), chosen.where("n_rows > 1")
    single = docs.join(once, docs["doc_id"].eqNullSafe(once["best_id"]), "left_semi")
    # only texts whose id stands in several rows are fingerprinted again
    # (written first: the planner would else move the join on fingerprints below this one)
    ids = often.select("best_id").distinct()
    several = materialise(docs.join(ids, docs["doc_id"].eqNullSafe(ids["best_id"]), "left_semi")).withColumn(fp, fingerprint(F.col("text"), shingle))
    joined = several.join(often, (several[fp] == often["best_fp"]) & several["doc_id"].eqNullSafe(often["best_id"]), "left_semi")
    order = [F.col("text"), *[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]]
    ranked = joined.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", fp).orderBy(*order)))
    return single.select(*docs.columns).union(ranked.where(F.col(rank) == 1).select(*docs.columns))
