"""Spark session helpers and the shared scratch location.

Scratch data (lineage cuts, chat source files, stream inputs) always goes
under the cluster's shared checkpoint folder, read from the session.  Only
when none is configured (local tests) do we pick one of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Written lineage cuts are removed once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "winnow",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()
_ZIP: list = []


def ship_package(spark: SparkSession) -> None:
    """Make ``winnow`` importable in the Python workers (``SparkContext.addPyFile``).

    Functions run by ``mapInArrow`` / ``applyInPandas`` are pickled by reference
    to this package, so every executor needs it; the driver zips the package
    once per process and Spark distributes the zip.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if not _ZIP:
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg)
        path = os.path.join(tempfile.mkdtemp(prefix="winnow-pkg-"), "winnow.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        _ZIP.append(path)
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    Also ships the package to the Python workers (once per application).
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # Unset: a local session (tests, bench).  A cluster must name a shared one.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="winnow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "winnow", f"{name}-{uuid.uuid4().hex[:12]}")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Inputs in this byte range are spread over the cores with a round-robin
# repartition (a few row groups cannot feed every core).  Larger inputs keep
# their file splits: no extra shuffle at scale.
SMALL_INPUT_MIN, SMALL_INPUT_MAX = 1 << 20, 64 << 20


def input_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def read_table(spark: SparkSession, sf_dir: str, name: str):
    path = table_path(sf_dir, name)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if cores > 1 and SMALL_INPUT_MIN <= input_bytes(spark, path) <= SMALL_INPUT_MAX:
        df = df.repartition(cores)
    return df


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where several branches of one plan read the same expensive table
    (e.g. the tokenized doc-term table): it is computed once, and the cut
    lineage means a lost executor re-reads files instead of re-running it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    A cut of the lineage like :func:`materialize`, for large tables: compressed columns in place of serialized
    rows (a fraction of the disk), and every reader prunes columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
