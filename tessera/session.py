"""Session construction and cluster-shared settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster, call with ``master=None`` so the launcher's master and
    shuffle sizing apply; the local defaults here are for tests/bench.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a folder of our own is only set
    when the session has none (local tests).
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext._jsc.sc().getCheckpointDir()
        cur = cur.get() if cur.isDefined() else None
    if not cur:
        master = spark.sparkContext.master or ""
        if fallback is None and not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder shared by the cluster "
                             "(e.g. on HDFS or an object store) before running tessera jobs")
        # local mode (tests, bench): a folder of our own is acceptable
        cur = fallback or os.path.join("/tmp", "tessera-checkpoints")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur
