"""A Spark session with the settings that the operators expect: UTC and adaptive execution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "glyphlake", **settings: str) -> SparkSession:
    """The active session, or a new one; settings override SETTINGS (dots in names as two underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a run on one machine gets a folder of its own; on a cluster this raises. What is written
    stays for the life of the application, as its results may read it; the cluster's owner clears the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors of a cluster need a folder that all share")
        base = f"file://{tempfile.mkdtemp(prefix='glyphlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glyphlake-{uuid.uuid4().hex}"
