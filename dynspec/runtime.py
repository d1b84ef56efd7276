"""What a session needs to run the package's functions in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if it is not on their path already."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. Where neither is set, in a temporary
    folder in local mode; a cluster has none that is shared, so there it is an error. Paths of the local file system come without a scheme, as programs other than Spark open them."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dynspec-")
    base = base.removeprefix("file://").removeprefix("file:")
    if "://" not in base:
        os.makedirs(base, exist_ok=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
