"""Session construction and shared-storage helpers.

Everything that must survive an executor loss (checkpoints, round-trip sinks)
goes under ``spark.checkpoint.dir``, which a cluster points at shared storage.
Only when that setting is absent (local tests) do we pick a directory ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "medlattice") -> SparkSession:
    """Session with AQE, UTC time and the UI off. Reuses a running session."""
    cpus = os.environ.get("BENCH_CPUS") or os.environ.get("MEDLATTICE_CPUS") or "8"
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MEDLATTICE_DRIVER_MEMORY", _default_heap()))
        # Broadcast only what is provably small; dictionaries are far below this.
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _default_heap() -> str:
    """Local mode runs everything in the driver JVM: half the machine's memory,
    between 2 and 16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gib = max(2, min(16, int(total / 2**30 / 2)))
    return f"{gib}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory; set a local one only if unset."""
    current = spark.conf.get(_CHECKPOINT_KEY, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{_CHECKPOINT_KEY} is not set: on {master} it must name a folder that "
                               "the driver and all executors share")
        current = tempfile.mkdtemp(prefix="medlattice-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    spark.sparkContext.setCheckpointDir(current)
    return spark.sparkContext.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate, on the shared checkpoint storage."""
    base = spark.conf.get(_CHECKPOINT_KEY, None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/medlattice-scratch/{name}-{uuid.uuid4().hex[:12]}"

