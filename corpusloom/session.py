"""A session with the settings the library expects."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "corpusloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, and Arrow; `master` and the shuffle width only where given."""
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.ignoreCorruptFiles": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        build = build.config(k, v)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return build.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of this process's own only where none is set and all runs on
    this machine (tests). On a cluster executors would write to disks of their own, so that is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="corpusloom-")
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared checkpoint folder, so lost executors cost nothing.

    Both sides of a later join then have exchanges of their own, which adaptive execution can split where skewed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
