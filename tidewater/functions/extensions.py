"""Functions added at run time: scalar UDFs, aggregates over a mergeable state, and plugins."""

from __future__ import annotations

import importlib
import importlib.util
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """An aggregate as state columns: what a batch adds, how states merge, what the result is.

    partial: argument -> {suffix: aggregate Column}; merge: suffix -> aggregate over a state
    column; final: {suffix: Column of merged state} -> result.
    """

    partial: Callable[[Column], dict[str, Column]]
    merge: Callable[[str, Column], Column]
    final: Callable[[dict[str, Column]], Column]


def _added(_: str, state: Column) -> Column:
    return F.sum(state)


AGGREGATES: dict[str, Aggregate] = {
    "sum": Aggregate(lambda x: {"": F.sum(x)}, _added, lambda s: F.coalesce(s[""], F.lit(0))),
    "count": Aggregate(lambda x: {"": F.count(x)}, _added, lambda s: F.coalesce(s[""], F.lit(0))),
    "avg": Aggregate(
        lambda x: {"_sum": F.sum(x.cast("double")), "_count": F.count(x)},
        _added,
        lambda s: F.coalesce(s["_sum"] / F.nullif(s["_count"], F.lit(0)), F.lit(0.0)),
    ),
}


def register_aggregate(name: str, aggregate: Aggregate) -> None:
    """Adds an aggregate, or replaces the one of that name; names are the same in either case."""
    AGGREGATES[name.lower()] = aggregate


def register_function(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """A function of pandas Series (batch at a time), usable in SQL and in filter texts."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def register_constant(spark: SparkSession, name: str, value: int) -> None:
    """A function without arguments that gives a BIGINT."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS BIGINT RETURN {int(value)}L")


def load_extensions(spark: SparkSession, place: str, entry: str = "register_extensions") -> object:
    """Imports a module (a dotted name or a .py file) and calls its entry point with the session."""
    if place.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(place).stem, place)
        if spec is None or not Path(place).exists():
            raise FileNotFoundError(place)
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(place)
    found = getattr(module, entry, None)
    if found is None:
        raise AttributeError(f"{place} has no {entry}()")
    found(spark)
    return module


