"""Session construction (tests, bench) and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app: str = "wardrank",
    extra: dict | None = None,
) -> SparkSession:
    """A session tuned for these workloads.

    AQE stays on: it coalesces the small post-aggregation shuffles, turns a
    sort-merge join into a broadcast join only when the *measured* build
    side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and
    splits skewed join partitions — also when the split costs one more
    shuffle downstream (``forceOptimizeSkewedJoin``), which is cheaper than a
    straggler task holding a hot key.  Post-shuffle partitions are sized by
    bytes (``parallelismFirst=false``: fewer, fuller tasks on a busy
    cluster), and the generated-code cache is large enough that a reporting
    workload cycling through dozens of queries does not recompile each
    stage.  The UI is off (no server).
    """
    master = master or os.environ.get("WARDRANK_MASTER", "local[8]")
    cores = 8
    if master.startswith("local[") and master[6:-1].isdigit():
        cores = int(master[6:-1])
    parts = shuffle_partitions or cores
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local-mode
    session (tests), whose one process sees its own disk, gets a private folder
    when it is unset; on a cluster that is an error, as executors would write
    to their own disks.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="wardrank-ckpt-")
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/wardrank/{name}-{uuid.uuid4().hex[:12]}"
