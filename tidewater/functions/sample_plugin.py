"""An example of a plugin: adds dynamic(), a function without arguments that gives 123."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater.functions.extensions import register_constant


def register_extensions(spark: SparkSession) -> None:
    register_constant(spark, "dynamic", 123)
