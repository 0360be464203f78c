"""The session that the engine's own programs use; queries run in whatever session they are given."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive plans; conf overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(master).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one (spark.checkpoint.dir; one of this process only in a local session)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='skein-')}"
    return f"{named}/skein/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the cluster's shared folder (spark.checkpoint.dir; one of its own only in a local session) and
    read from there: whatever is computed from it sees the same rows in the same partitions."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return df.checkpoint()


def share_path(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (on a cluster it is installed, or sent with
    the job)."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
