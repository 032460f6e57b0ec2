"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets the row-text and paged sources see the filters of a query.
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tidewater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS under whatever conf gives.

    Only a local master gets a small number of shuffle partitions; a cluster
    keeps its own setting, which AQE coalesces.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):
            cores = master[6:-1]
            settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() if cores == "*" else cores)
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
