"""What the training-data operators share: written tables and small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.relational import plan_bytes
from tidewater.scratch import drop_path, scratch_path, shared_dir  # noqa: F401  for the operators
from tidewater.shipping import ship  # noqa: F401


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a scratch table and reads it back.

    Cuts the lineage with files that outlive any executor, so what is derived from the
    table is computed from the same rows however often a task is run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def release(settled: DataFrame) -> None:
    """Deletes a table of settle() from which nothing is computed any more: all that came of it is written."""
    drop_path(settled.sparkSession, settled._settled_at)


def spread(df: DataFrame) -> DataFrame:
    """Deals a table in fewer files than there are cores, and too small for Spark to cut into a part for each, out to all cores.

    A small file is often one row group, which one task reads. The rows are the same; what a scan can deal out by
    itself (spark.sql.files.maxPartitionBytes) is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if plan_bytes(df) < cores * part and 0 < len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(key=None, make: Callable | None = None):
    """What a Python worker keeps between tasks: one thing, made when a task first asks for it.

    Another key, or none, lets go of it, so the memory of one operator isn't held through the next one's stages.
    """
    if key is None or key not in _held:
        _held.clear()
        if key is not None:
            _held[key] = make()
    return _held.get(key)
