"""The engine's operators, DataFrame in and DataFrame out; Catalyst plans them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.extensions import AGGREGATES

_CALL = re.compile(r"\s*(\w+)\s*\(\s*(\w+|\*)\s*\)\s*(?:as\s+(\w+)\s*)?", re.IGNORECASE)
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "anti": "left_anti"}


# --- filters and projections ------------------------------------------------------------


def where(df: DataFrame, *predicates: str | Column) -> DataFrame:
    """Rows for which all predicates hold. A predicate is a whole boolean expression; anything after it is an error."""
    for p in predicates:
        df = df.where(text.condition(p) if isinstance(p, str) else p)
    return df


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns by name, "expression AS name" text, or Column."""
    return df.select(*(text.value(c) if isinstance(c, str) else c for c in columns))


# --- aggregation ------------------------------------------------------------------------


def parse_aggregate(call: str) -> tuple[str, str, str]:
    """Function, argument and name of "function(argument) AS name"."""
    found = _CALL.fullmatch(call)
    if not found:
        raise ValueError(f"not an aggregate: {call!r}")
    function, argument, name = found.groups()
    if function.lower() not in AGGREGATES:
        raise ValueError(f"unknown aggregate {function!r}")
    return function.lower(), argument, name or f"{function}({argument})"


def _argument(name: str) -> Column:
    return F.lit(1) if name in ("1", "*") else F.col(name)


def partial_state(aggregates: Sequence[str]) -> list[Column]:
    """State columns of raw rows: the name for sum and count, name_sum and name_count for avg."""
    out = []
    for function, argument, name in map(parse_aggregate, aggregates):
        out += [c.alias(name + suffix) for suffix, c in AGGREGATES[function].partial(_argument(argument)).items()]
    return out


def _suffixes(function: str) -> list[str]:
    return list(AGGREGATES[function].partial(F.lit(1)))


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """Groups and aggregates in one step; Catalyst splits it into a map-side and a final part.

    Without aggregates: the distinct keys. Without keys: one row, also for no input, in which
    sum and avg are 0.
    """
    if not aggregates:
        return df.select(*keys).distinct()
    state = df.groupBy(*keys).agg(*partial_state(aggregates))
    return _finished(state, keys, aggregates)


def _finished(state: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    results = []
    for function, _, name in map(parse_aggregate, aggregates):
        merged = {suffix: F.col(f"`{name}{suffix}`") for suffix in _suffixes(function)}
        results.append(AGGREGATES[function].final(merged).alias(name))
    return state.select(*keys, *results)


def partial_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """One row of mergeable state per key and input partition; no row for no input."""
    state = df.groupBy(F.spark_partition_id().alias("_part"), *keys).agg(*partial_state(aggregates)).drop("_part")
    return state


def merge_aggregate(state: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """State in, state out: one row per key."""
    merged = []
    for function, _, name in map(parse_aggregate, aggregates):
        merged += [AGGREGATES[function].merge(s, F.col(f"`{name}{s}`")).alias(name + s) for s in _suffixes(function)]
    return state.groupBy(*keys).agg(*merged)


def final_aggregate(state: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    """Results of state; inputs are found by the name of the output."""
    return _finished(merge_aggregate(state, keys, aggregates), keys, aggregates)


# --- joins ------------------------------------------------------------------------------


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_join(
    probe: DataFrame,
    build: DataFrame,
    probe_keys: Sequence[str],
    build_keys: Sequence[str],
    how: str = "inner",
    residual: str | None = None,
    output: Sequence[str] | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """An equi-join on the key lists with a residual condition and an output list.

    The sides are named probe and build in the residual and in the output ("build.name AS n").
    Null keys match nothing. The build side is broadcast only if its estimated size is at most
    broadcast_bytes (by default Spark's own threshold decides); otherwise both sides are
    shuffled and AQE splits skewed partitions.
    """
    if len(probe_keys) != len(build_keys) or not probe_keys:
        raise ValueError("as many keys on either side, and one at least")
    if broadcast_bytes is not None:
        build = F.broadcast(build) if plan_bytes(build) <= broadcast_bytes else build.hint("merge")
    left, right = probe.alias("probe"), build.alias("build")
    condition = None
    for a, b in zip(probe_keys, build_keys):
        same = F.col(f"probe.{a}") == F.col(f"build.{b}")
        condition = same if condition is None else condition & same
    if residual:
        condition = condition & text.condition(residual)
    joined = left.join(right, condition, JOINS[how])
    return joined.select(*(text.value(c) for c in output)) if output else joined


# --- sorts ------------------------------------------------------------------------------


def sort_keys(keys: Sequence[str]) -> list[Column]:
    """Columns of "name", "name ASC" or "name DESC"; ascending puts nulls first, descending last."""
    out = []
    for key in keys:
        name, _, way = key.strip().partition(" ")
        way = way.strip().upper() or "ASC"
        if way not in ("ASC", "DESC"):
            raise ValueError(f"not a sort key: {key!r}")
        out.append(F.col(name).desc() if way == "DESC" else F.col(name).asc())
    return out


def order_by(df: DataFrame, keys: Sequence[str], partial: bool = False) -> DataFrame:
    """A total order, or one inside each partition."""
    return df.sortWithinPartitions(*sort_keys(keys)) if partial else df.orderBy(*sort_keys(keys))


def top_n(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order; a negative n is no limit. Each partition keeps n rows, no full sort."""
    ordered = df.orderBy(*sort_keys(keys))
    return ordered if n < 0 else ordered.limit(n)


# --- exchanges --------------------------------------------------------------------------


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Deals rows to partitions, by keys if there are any."""
    return df.repartition(partitions, *keys)


def gather(df: DataFrame, partitions: int = 1) -> DataFrame:
    """Fewer partitions, in no particular order; what makes the rows keeps its own number of tasks."""
    return df.repartition(partitions)
