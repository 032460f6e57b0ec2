"""Tables that last as long as this Python process, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that Spark and the tasks' own readers and writers mean the same place."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the master is
    this machine (tests) a folder of its own is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tidewater-shared")
    return qualified(spark, folder).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under shared_dir(); it goes when this Python process ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked through Hadoop's file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop's file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may be gone; the folder is the cluster's to clean then
            continue
