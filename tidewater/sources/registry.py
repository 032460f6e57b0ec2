"""Readers by format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources import paged, rowtext, typed_csv

READERS: dict[str, Callable[..., DataFrame]] = {
    "rowtext": rowtext.read,
    "csv": typed_csv.read,
    "paged": paged.read,
    "parquet": lambda spark, paths, **options: spark.read.options(**options).parquet(*([paths] if isinstance(paths, str) else paths)),
}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a format, or replaces its reader."""
    READERS[name] = reader


def read(spark: SparkSession, name: str, paths, **options) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"no reader for {name!r}")
    return READERS[name](spark, paths, **options)
