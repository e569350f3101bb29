"""Landed API pages with a quarantine.

A page is one file that holds one JSON array of records. Every page is judged
whole: the records of a good page go on, a page that is anything else (cut off,
an error message, two arrays in one file, an element that is no record, an empty
file) goes into quarantine with its path and text, and none of its records go
on, so that landing it again adds them once. An empty array is a good page
without records.

Pages and records come out of the same pass as rows of one table, told apart by
the partition column ``kind``: ``page`` rows are the ledger, one per file, and
``record`` rows the records. Batch and stream share that table's form, so a reader
of either prunes to the folder it wants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.sources.files import RAW_SCHEMA

#: Why a page is in quarantine.
NOT_AN_ARRAY, NOT_RECORDS, EMPTY_FILE = "not one JSON array", "an element is no record", "empty file"

#: Streams of one landing that run side by side.
STREAMS = 12

_PAGE = "page string, bytes long, n_records long, reason string, body string"


@dataclass(frozen=True)
class Pages:
    """Rows of kind page and record, and the paths of all files that landed."""

    rows: DataFrame
    listed: DataFrame
    schema: T.StructType = RAW_SCHEMA

    @property
    def records(self) -> DataFrame:
        """The records of all good pages, with the path of their page."""
        return self.rows.where("kind = 'record'").select(*self.schema.names, "page")

    @property
    def ledger(self) -> DataFrame:
        """(page, bytes, n_records, reason): one row per landed file. A file of no
        bytes gives a reader no row; it is found by its absence."""
        seen = self.rows.where("kind = 'page'").select("page", "bytes", "n_records", "reason")
        missing = self.listed.join(seen, "page", "left_anti")
        return seen.unionByName(missing.selectExpr("page", "0L AS bytes", "0L AS n_records", f"'{EMPTY_FILE}' AS reason"))

    @property
    def quarantine(self) -> DataFrame:
        """(page, bytes, reason, body) of the pages that are not whole."""
        bad = self.rows.where("kind = 'page' AND reason IS NOT NULL").select("page", "bytes", "reason", "body")
        missing = self.listed.join(self.rows.where("kind = 'page'").select("page"), "page", "left_anti")
        return bad.unionByName(missing.selectExpr("page", "0L AS bytes", f"'{EMPTY_FILE}' AS reason", "'' AS body"))


def _reason(body: Column, records: Column) -> Column:
    """Null for a whole page. The body set into brackets must be an array of one
    element: a second value behind the first one would else be passed over."""
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    is_array = F.json_array_length(body).isNotNull() & F.coalesce(alone, F.lit(False))
    return F.when(body.rlike(r"\A\s*\z"), F.lit(EMPTY_FILE)).when(~is_array, F.lit(NOT_AN_ARRAY)).when(records.isNull(), F.lit(NOT_RECORDS))


def page_rows(files: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Whole files (``value``, as ``spark.read.text(..., wholetext=True)`` gives
    them) as rows of kind ``page`` and ``record``."""
    page = F.input_file_name().alias("page")  # as listed, unlike _metadata.file_path
    read = files.select(page, F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("body"))
    read = read.withColumn("records", F.from_json("body", T.ArrayType(schema)))
    read = read.withColumn("reason", _reason(F.col("body"), F.col("records")))
    good = F.when(F.col("reason").isNull(), F.col("records")).otherwise(F.array().cast(T.ArrayType(schema)))
    whole = F.struct(
        F.lit("page").alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema],
        F.col("bytes"), F.size(good).cast("long").alias("n_records"), F.col("reason"),
        F.when(F.col("reason").isNotNull(), F.col("body")).alias("body"),
    )
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("bytes", "long"), ("n_records", "long"), ("reason", "string"), ("body", "string"))]
    each = F.transform(good, lambda r: F.struct(F.lit("record").alias("kind"), *[r[f.name].alias(f.name) for f in schema], *nothing))
    return read.select("page", F.explode(F.concat(F.array(whole), each)).alias("r")).select("page", "r.*")


def _listed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The paths of all landed files: the listing that Spark's reader holds anyway."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).inputFiles()
    return spark.createDataFrame([(f,) for f in files], "page string")


def read_pages(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA) -> Pages:
    """Pages of a folder or of files; each part is read when it is used. To read
    the pages once, write them with ``land_pages``."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    return Pages(page_rows(files, schema), _listed(spark, path), schema)


def _written(spark: SparkSession, landing: str | Sequence[str], outs: Sequence[str], schema: T.StructType) -> Pages:
    fields = [T.StructField("page", T.StringType()), *schema.fields, *T._parse_datatype_string(_PAGE).fields[1:], T.StructField("kind", T.StringType())]
    # each by itself: a file sink's log is heeded only where its own folder is read
    parts = [spark.read.schema(T.StructType(fields)).parquet(out) for out in outs]
    return Pages(reduce(DataFrame.unionByName, parts), _listed(spark, landing), schema)


def land_pages(spark: SparkSession, path: str | Sequence[str], out: str, schema: T.StructType = RAW_SCHEMA) -> Pages:
    """Read pages once into the table ``out`` (partitioned by ``kind``) and give
    its parts."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    page_rows(files, schema).write.partitionBy("kind").parquet(out)
    return _written(spark, path, [out], schema)


def append_pages(
    spark: SparkSession,
    landing: str | Sequence[str],
    out: str,
    checkpoint: str,
    schema: T.StructType = RAW_SCHEMA,
    files_per_trigger: int | None = None,
    tasks_per_trigger: int | None = None,
) -> Pages:
    """Add the pages that have landed since the last run to the table ``out``.

    A file sink's log makes each page, its records and its place in quarantine
    appear once, whatever is run again. A page that was in quarantine and lands
    anew under another name is a new page.

    A trigger costs the driver some writes of logs however few files it takes. So
    a landing may be several folders: each is added by a stream of its own, up to
    ``STREAMS`` side by side, to a part of the table and with progress that belong
    to that folder's path. If one stream fails, the others end their run before
    the error is raised. ``tasks_per_trigger`` keeps a trigger of few small pages
    from leaving a file for every core."""
    folders = [landing] if isinstance(landing, str) else list(dict.fromkeys(f.rstrip("/") for f in landing))
    own = [""] if isinstance(landing, str) else [f"/{hashlib.sha256(f.encode()).hexdigest()[:16]}" for f in folders]
    outs = [out + o for o in own]

    def add(folder: str, to: str, progress: str) -> None:
        reader = spark.readStream.format("text").option("wholetext", True)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        rows = page_rows(reader.load(folder), schema)
        if tasks_per_trigger:
            rows = rows.coalesce(tasks_per_trigger)
        writer = rows.writeStream.format("parquet").partitionBy("kind")
        run = writer.option("checkpointLocation", progress).option("path", to).trigger(availableNow=True).start()
        run.awaitTermination()

    with ThreadPoolExecutor(STREAMS) as pool:
        list(pool.map(add, folders, outs, [checkpoint + o for o in own]))
    return _written(spark, landing if isinstance(landing, str) else folders, outs, schema)
