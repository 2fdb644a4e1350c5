"""Session settings the jobs are written for."""
from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "lexweave", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` only for local runs."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="lexweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package wherever the driver runs from (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="lexweave-pkg-"), "lexweave")
    sc.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(home), os.path.basename(home)))
    _SHIPPED.add(sc.applicationId)
