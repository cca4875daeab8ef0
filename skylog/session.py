"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs are written for. A cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM leaves larger methods uncompiled; wide projections then run as many small ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # whole files travel to the Python parser: bound a batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(cores: str | int = "*", app: str = "skylog", **conf: str) -> SparkSession:
    """A local session with the default settings (tests, bench, exploration)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the method limit of :data:`DEFAULTS`, unless it has one of its own.

    The limit of Spark itself lets the wide projections run as one method that the JVM interprets and never compiles.
    """
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, DEFAULTS[METHOD_LIMIT])
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name for intermediate tables, under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of this machine; on a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
