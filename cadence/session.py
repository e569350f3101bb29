"""Spark session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every result depends on (naive timestamps, see README "Time zone")
# plus the adaptive-execution switches that let Spark re-plan joins and
# partition counts from the sizes it sees at run time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle partitions to the advisory size rather than to the
    # default parallelism: no crowd of tiny tasks on a busy cluster
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings for a large cluster (about 1000 executors, 100 TB of Parquet).
# A report scans a few columns of the facts (a tenth or so of the bytes), in
# splits of 256 MB; the first shuffle carries partial aggregates only. The
# shuffle starts wide and adaptive execution coalesces it to ~256 MB
# partitions, splits skewed ones, and turns sort-merge joins of small
# aggregates into broadcast joins at run time. Speculation re-runs stragglers
# (a slow or lost executor); RocksDB keeps large streaming state off the heap.
CLUSTER_PROFILE = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.speculation": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    master: str | None = None,
    app: str = "cadence",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    profile: str | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings of SESSION_DEFAULTS.

    ``shuffle_partitions`` should be about the core count in local runs.
    ``profile="cluster"`` adds CLUSTER_PROFILE (explicit ``extra`` settings
    still win).
    """
    if profile not in (None, "local", "cluster"):
        raise ValueError("profile must be 'local' or 'cluster'")
    if profile == "cluster":
        extra = {**CLUSTER_PROFILE, **(extra or {})}
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Pin the runtime settings results depend on, on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _conf_checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # Spark Connect has no SparkContext
        value = None
    if not value:
        try:
            value = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:
            value = None
    return value or None


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is missing in a local-mode session (a bare test
    session) a fresh local folder is made and registered as the checkpoint
    folder; a cluster session without the setting is an error, never a
    machine-local folder.
    """
    root = _conf_checkpoint_dir(spark)
    if root:
        return root.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception as exc:  # a remote (Spark Connect) session: no local fallback
        raise RuntimeError("set spark.checkpoint.dir to a folder on the shared file system") from exc
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on the shared file system")
    root = tempfile.mkdtemp(prefix="cadence-ckpt-")
    sc.setCheckpointDir(root)
    sc._conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared root (one per run, never reused)."""
    return f"{shared_root(spark)}/cadence/{name}-{uuid.uuid4().hex[:12]}"
