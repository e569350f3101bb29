"""Report sinks: headered CSV, year- and month-partitioned tables, named
report bundles, appends, and never-overwrite run folders.

Writers are distributed (one file per task); nothing is gathered on the
driver. Paths must be on the shared file system (see ``session.shared_dir``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> str:
    """CSV with a header line in every part file."""
    w = df.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("year",),
    fmt: str = "parquet",
    mode: str = "errorifexists",
    order: Sequence[str] = (),
) -> str:
    """One folder per value of ``by`` (``year=2023/``, ``month=1/`` ...), the
    rows of every file in the order of the columns ``order``.

    Rows are clustered on the partition columns first so each task writes
    few files, instead of one file per partition value per task. The
    clustering is a ``rebalance`` hint, not ``repartition``: adaptive
    execution splits a partition value that holds much of the data (a hot
    year) over several tasks instead of giving it to one."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    clustered = df.hint("rebalance", *by) if by else df
    if order:  # after the clustering, which would undo a sort before it
        clustered = clustered.sortWithinPartitions(*by, *[c for c in order if c not in by])
    w = clustered.write.mode(mode).partitionBy(*by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def run_folder(root: str, now: datetime | None = None) -> str:
    """A dated folder for one run; writes into it use ``errorifexists``, so
    an earlier run is never overwritten."""
    now = now or datetime.now(timezone.utc)
    return f"{root.rstrip('/')}/run_ts={now.strftime('%Y%m%dT%H%M%S%fZ')}"


def write_bundle(
    tables: Mapping[str, DataFrame],
    root: str,
    fmt: str = "parquet",
    partition_by: Mapping[str, Sequence[str]] | None = None,
    parallel: bool = True,
    order: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """A report bundle: every named table in ``<root>/<name>/``.

    ``order`` names the columns that a partitioned table's files are sorted by.
    Returns name -> path. Each table is its own distributed write; the
    writes are submitted together (Spark runs jobs from several driver
    threads at once), so a bundle of small tables takes about as long as its
    largest table instead of the sum of all."""
    partition_by = partition_by or {}
    order = order or {}

    def write_one(name: str, df: DataFrame) -> str:
        path = f"{root.rstrip('/')}/{name}"
        by = list(partition_by.get(name, ()))
        if by:
            write_partitioned(df, path, by, fmt=fmt, order=order.get(name, ()))
        elif fmt == "csv":
            write_csv(df, path)
        else:
            df.write.mode("errorifexists").parquet(path)
        return path

    if not parallel or len(tables) < 2:
        return {name: write_one(name, df) for name, df in tables.items()}
    with ThreadPoolExecutor(max_workers=min(8, len(tables))) as pool:
        futures = {name: pool.submit(write_one, name, df) for name, df in tables.items()}
        return {name: f.result() for name, f in futures.items()}


def append(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Add rows to a table; the CSV header is written with every part file,
    so readers with ``header=true`` see it exactly once per file."""
    w = df.write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def materialize(spark, df: DataFrame, path: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table at ``path`` (on the shared
    file system) and read it back. Lineage is cut there, a lost executor
    re-reads the table instead of recomputing it, and the planner sees the
    table's real size -- so a join with it is broadcast only when it is
    actually small, and stays a sort-merge join when it is not."""
    df.write.parquet(path)
    return spark.read.parquet(path)


def _path_of(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_folders(spark, path: str) -> list[str]:
    """Names of the folders in ``path`` (none if there is no such path), on whatever
    file system the session reads."""
    p, fs = _path_of(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def delete_folder(spark, path: str) -> bool:
    """Remove a folder with what it holds; False if there was none."""
    p, fs = _path_of(spark, path)
    return bool(fs.delete(p, True))
