"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned by a seeded random rotation and cut into groups of a few
dimensions; every group, shifted by an offset of its own, gives a Hilbert curve
through all vectors. Along each curve vectors are range-partitioned and get
dense positions. A query looks at the positions within a window around its own
on every curve; the windows of all curves merge, and candidates are ranked by
their exact distance.

The window is a share of all vectors, fitted before the search: for a bounded,
documented sample of queries the true neighbours are found by comparing the
sample with all vectors in blocks, and the window becomes the distance along
the best curve within which the wanted share of them lies, with a margin. Data
with little structure needs wide windows and data with much structure narrow
ones; nothing is capped.

Windows are cut into chunks of bounded size, met by blocks of queries of
bounded size, so no group grows with the data. Equal vectors are one vector
with its ``k + 1`` smallest ids, the only ones that can be among a result's k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cadence.llm.common import materialise, ship_package, with_position

#: Dimensions of a curve, and bits of each.
CURVE_DIMS, CURVE_BITS = 4, 8
#: Vectors of a chunk, and queries that meet it at once.
CHUNK, QUERY_BLOCK = 2048, 1024
#: Queries that the window is fitted on, the share of their neighbours it must
#: reach, and the factor on it.
SAMPLE, TARGET, MARGIN = 100, 0.95, 1.1


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of cell numbers (0 to 2^bits - 1):
    the transposed index by exchanges and inversions from the top bit down, then
    Gray-decoded and interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def curve_keys(vectors: np.ndarray, scale: float, seed: int) -> np.ndarray:
    """(rows, curves) of Hilbert keys. Projections are measured in ``scale`` (the
    root mean square of a coordinate) and mapped to cells by a smooth step, so
    that far vectors keep an order; curve c is shifted by its own fraction of a
    cell group."""
    dim = vectors.shape[1]
    turned = vectors @ rotation(dim, seed)
    groups = [list(range(a, min(a + CURVE_DIMS, dim))) for a in range(0, dim, CURVE_DIMS)]
    offsets = np.random.default_rng(seed + 1).uniform(-0.25, 0.25, size=(len(groups), CURVE_DIMS))
    out = []
    for c, dims in enumerate(groups):
        z = turned[:, dims] / (scale or 1.0) + offsets[c, : len(dims)]
        cells = np.floor((0.5 + 0.5 * z / np.sqrt(1 + z * z)) * (1 << CURVE_BITS))
        out.append(hilbert_key(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS))
    return np.stack(out, axis=1) if out else np.zeros((len(vectors), 0), dtype=np.int64)


def _as_matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec array<double>): rows that take part. Null vectors, those with null
    or non-finite components, zero and empty ones, and null ids do not; nor do
    vectors of another length than the most frequent (of equally frequent, the
    shortest)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where("id is not null and vec is not null").where(F.forall("vec", sound) & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    return rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vid, vec, ids): each different vector once, with its ``k + 1`` smallest
    ids; vid is the smallest."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "vec", "ids")


def nearest_in_block(queries: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(place of query, place of vector, distance) of all vectors of a block that can be among a
    query's k nearest ids within it. Distances are summed from differences."""
    out = []
    if not len(vectors):
        return out
    rough = (queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)[None]
    take = min(k + 1, len(vectors))
    edge = np.partition(rough, take - 1, axis=1)[:, take - 1]
    slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
    for q in range(len(queries)):
        near = np.flatnonzero(rough[q] <= edge[q] + slack[q])
        exact = np.sqrt(((vectors[near] - queries[q]) ** 2).sum(axis=1))
        out += [(q, int(v), float(d)) for v, d in zip(near, exact, strict=True)]
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows (query_id, vec_id, score) of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _join_blocks(queries: DataFrame, vectors: DataFrame, key: list[str], k: int) -> DataFrame:
    """Nearest (query, vid) within each key's block of queries (qid, qvec) and vectors (vid, vec)."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        qid, vid = left["qid"].to_numpy(), right["vid"].to_numpy()
        got = nearest_in_block(_as_matrix(left["qvec"]), _as_matrix(right["vec"]), k)
        return pd.DataFrame({"qid": [int(qid[q]) for q, _, _ in got], "vid": [int(vid[v]) for _, v, _ in got], "score": [d for _, _, d in got]})

    # new names: both sides descend from the same positions
    vectors = vectors.select("vid", "vec", *[F.col(c).alias(f"{c}_of_vector") for c in key])
    return queries.groupBy(*key).cogroup(vectors.groupBy(*[f"{c}_of_vector" for c in key])).applyInPandas(meet, "qid long, vid long, score double")


def search_all(queries: list, vectors: DataFrame, k: int) -> DataFrame:
    """Exact: (qid, vid, score) with the nearest distinct vectors of each of a
    bounded list of queries (qid, qvec): each task compares them with its
    vectors batch by batch."""
    qids = [q["qid"] for q in queries]
    asked = _as_matrix([q["qvec"] for q in queries])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vids = b["vid"].to_numpy()
            got = nearest_in_block(asked, _as_matrix(b["vec"]), k)
            yield pd.DataFrame({"qid": [qids[q] for q, _, _ in got], "vid": [int(vids[v]) for _, v, _ in got], "score": [d for _, _, d in got]})

    return vectors.select("vid", "vec").mapInPandas(compare, "qid long, vid long, score double")


def curve_positions(vectors: DataFrame, scale: float, seed: int) -> DataFrame:
    """(vid, curve, pos): the dense position of every vector on every curve."""

    @arrow_udf("array<long>")
    def keys(vecs: pa.Array) -> pa.Array:
        if not len(vecs):
            return pa.array([], type=pa.list_(pa.int64()))
        return pa.array(list(curve_keys(_as_matrix(vecs.to_pylist()), scale, seed)), type=pa.list_(pa.int64()))

    placed = vectors.select("vid", F.posexplode(keys(F.col("vec"))).alias("curve", "key"))
    ranked = with_position(placed, ["curve", "key", "vid"], "pos")
    starts = ranked.groupBy("curve").agg(F.min("pos").alias("start"))  # one row per curve
    return ranked.join(F.broadcast(starts), "curve").select("vid", "curve", (F.col("pos") - F.col("start")).alias("pos"))


def fit_window(positions: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, n: int) -> int:
    """The window (positions each side) that reaches TARGET of the sample's true
    neighbours on their best curve, times MARGIN, and at least 4 k. The sample is the
    SAMPLE queries with the smallest hashes."""
    chosen = queries.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).collect()
    if not chosen:
        return n
    sample = queries.sparkSession.createDataFrame([(q["qid"],) for q in chosen], "vid long")
    truth = search_all(chosen, vectors, k).where("qid <> vid")
    truth = truth.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vid"))).where(F.col("r") <= k)
    # at most SAMPLE * k pairs, each with one row per curve
    pairs = F.broadcast(truth.select("qid", "vid"))
    at_v = positions.join(pairs, "vid").select("qid", "vid", "curve", F.col("pos").alias("vpos"))
    at_q = positions.join(F.broadcast(sample), "vid").select(F.col("vid").alias("qid"), "curve", F.col("pos").alias("qpos"))
    gaps = at_v.join(at_q, ["qid", "curve"]).groupBy("qid", "vid").agg(F.min(F.abs(F.col("vpos") - F.col("qpos"))).alias("gap"))
    got = np.sort([r["gap"] for r in gaps.collect()])  # at most SAMPLE * k numbers
    reach = int(got[min(len(got) - 1, int(np.ceil(TARGET * len(got))))]) if len(got) else n
    return max(4 * k, int(reach * MARGIN) + 1)


def nearest_neighbours(vectors: DataFrame, query_filter: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``query_filter`` (on a
    column ``id``) names, the k nearest other rows found, by Euclidean distance.

    Ties go to the smaller id. Rows of equal vectors are candidates each, at
    distance zero of each other. Rows with an unusable vector (see ``usable``)
    take no part on either side; fewer candidates than k give fewer rows; rows
    that repeat an id with the same vector count once, and of an id with several
    vectors each takes part. Empty tables give no rows; other columns are
    ignored. ``window`` overrides the fitted one.
    """
    ship_package(vectors.sparkSession)
    rows = materialise(usable(vectors, id_col, vec_col))
    distinct = materialise(distinct_vectors(rows, k))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x) / size(vec)")).alias("m")).first()
    n = size["n"]
    asked = rows.where(query_filter).join(distinct.select("vec", "vid"), "vec").select(F.col("id"), "vid", F.col("vec"))
    asked = materialise(asked)
    queries = asked.groupBy("vid").agg(F.first("vec").alias("qvec")).withColumnRenamed("vid", "qid")
    positions = materialise(curve_positions(distinct, float(np.sqrt(size["m"] or 0.0)), seed))
    reach = window or fit_window(positions, distinct, queries, k, n)

    by_place = positions.join(distinct.select("vid", "vec"), "vid")
    chunked = by_place.select("vid", "vec", "curve", F.floor(F.col("pos") / CHUNK).alias("chunk"))
    at = positions.join(queries, positions["vid"] == queries["qid"]).select("qid", "qvec", "curve", "pos")
    low = F.floor(F.greatest(F.col("pos") - reach, F.lit(0)) / CHUNK)
    high = F.floor(F.least(F.col("pos") + reach, F.lit(max(n - 1, 0))) / CHUNK)
    # queries of a block lie close on the curve; those that a chunk meets come in
    # blocks, and the chunk is copied to each block that reaches it
    block = F.floor(F.col("pos") / F.lit(max(CHUNK, QUERY_BLOCK * 16)))
    wide = at.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("block", block)
    blocks = wide.select("curve", "chunk", "block").distinct()
    copies = chunked.join(blocks, ["curve", "chunk"])
    found = _join_blocks(wide.select("qid", "qvec", "curve", "chunk", "block"), copies, ["curve", "chunk", "block"], k)
    # once per pair, whichever curves found it; then the ids that share a vector
    pairs = found.groupBy("qid", "vid").agg(F.min("score").alias("score"))
    nearest = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vid"))).where(F.col("r") <= k + 1)
    spread = nearest.join(distinct.select("vid", F.explode("ids").alias("vec_id")), "vid").select("qid", "vec_id", "score")
    few = spread.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    answered = asked.select(F.col("id").alias("query_id"), F.col("vid").alias("qid")).join(few, "qid").where("query_id <> vec_id")
    return _best(answered, k)
