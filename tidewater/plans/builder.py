"""A fluent builder of plans, and tasks that run them over splits."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from tidewater.operators import relational as ops


class Plan:
    """Wraps a DataFrame; each step returns a new plan."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, *predicates) -> Plan:
        return Plan(ops.where(self.df, *predicates))

    def project(self, *columns) -> Plan:
        return Plan(ops.project(self.df, *columns))

    def single_aggregation(self, keys: Sequence[str], aggregates: Sequence[str]) -> Plan:
        return Plan(ops.aggregate(self.df, keys, aggregates))

    def partial_aggregation(self, keys: Sequence[str], aggregates: Sequence[str]) -> Plan:
        return Plan(ops.partial_aggregate(self.df, keys, aggregates))

    def intermediate_aggregation(self, keys: Sequence[str], aggregates: Sequence[str]) -> Plan:
        return Plan(ops.merge_aggregate(self.df, keys, aggregates))

    def final_aggregation(self, keys: Sequence[str], aggregates: Sequence[str]) -> Plan:
        return Plan(ops.final_aggregate(self.df, keys, aggregates))

    def hash_join(self, probe_keys, build_keys, build: Plan | DataFrame, residual=None, output=None, how="inner") -> Plan:
        return Plan(ops.hash_join(self.df, build.df if isinstance(build, Plan) else build, probe_keys, build_keys, how, residual, output))

    def order_by(self, keys: Sequence[str], partial: bool = False) -> Plan:
        return Plan(ops.order_by(self.df, keys, partial))

    def top_n(self, keys: Sequence[str], n: int) -> Plan:
        return Plan(ops.top_n(self.df, keys, n))

    def local_partition(self, partitions: int, *keys: str) -> Plan:
        return Plan(ops.spread(self.df, partitions, *keys))

    def local_merge(self, partitions: int = 1) -> Plan:
        return Plan(ops.gather(self.df, partitions))

    def apply(self, step: Callable[[DataFrame], DataFrame]) -> Plan:
        """A user's own operator, such as one over mapInPandas or mapInArrow."""
        return Plan(self.df.transform(step))

    def explain(self, mode: str = "formatted") -> str:
        return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)


class TaskCancelled(RuntimeError):
    """The task was cancelled."""


class Task:
    """Runs a plan over splits that are added one by one, and can be cancelled.

    scans names the plan's scans; each gets splits of its own. build makes the plan from the paths of the splits: a
    list, or a dict of lists by scan if there are several. Rows come out of next() once
    every scan has all its splits. A plan that works row by row (one scan, filters, projections: row_by_row) need not wait: it
    runs over the splits that are there, and again over those that have come meanwhile.
    """

    def __init__(self, spark: SparkSession, build: Callable[..., DataFrame], scans: Sequence[str] = ("scan",), row_by_row: bool = False):
        if row_by_row and len(scans) != 1:
            raise ValueError("a plan that works row by row has one scan")
        self.spark, self.build, self.row_by_row = spark, build, row_by_row
        self.splits: dict[str, list[str]] = {scan: [] for scan in scans}
        self.open = set(scans)
        self.cancelled = False
        self.changed = threading.Condition()
        self.tag = f"task-{uuid.uuid4().hex}"
        self._rows: Iterator[Row] | None = None

    def _scan(self, scan: str | None) -> str:
        if scan is None and len(self.splits) == 1:
            return next(iter(self.splits))
        if scan not in self.splits:
            raise ValueError(f"no scan {scan!r}")
        return scan

    def add_split(self, path: str, scan: str | None = None) -> None:
        with self.changed:
            if (scan := self._scan(scan)) not in self.open:
                raise RuntimeError("no more splits were announced")
            self.splits[scan].append(path)
            self.changed.notify_all()

    def no_more_splits(self, scan: str | None = None) -> None:
        """For one scan, or for all."""
        with self.changed:
            self.open -= set(self.splits) if scan is None else {self._scan(scan)}
            self.changed.notify_all()

    def _next_splits(self):
        """What to run over next: all splits, or those that came meanwhile; None if there is nothing left."""
        with self.changed:
            ready = lambda: self.cancelled or not self.open or self.row_by_row and any(self.splits.values())
            self.changed.wait_for(ready)
            if self.cancelled:
                raise TaskCancelled
            if not self.row_by_row:
                return next(iter(self.splits.values())) if len(self.splits) == 1 else self.splits
            (scan, there), = self.splits.items()
            self.splits[scan] = []
            return there or None

    def _begin(self, splits) -> Iterator[Row]:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)  # what this thread starts from here on, cancel() can end
        try:
            return self.build(splits).toLocalIterator()
        finally:
            context.removeJobTag(self.tag)

    def next(self) -> Row | None:
        """The next row, None after the last; waits for splits. Raises TaskCancelled once the task is cancelled."""
        try:
            while not self.cancelled:
                if self._rows is None:
                    if (splits := self._next_splits()) is None:
                        return None
                    self._rows = self._begin(splits)
                row = next(self._rows, None)
                if row is not None and not self.cancelled:
                    return row
                if not self.row_by_row and not self.cancelled:
                    return None
                self._rows = None
        except Exception as problem:
            if not self.cancelled:
                raise
            self._rows = None
            raise TaskCancelled from problem
        raise TaskCancelled

    def cancel(self) -> None:
        """Ends the task, from any thread, and whatever job it is running."""
        with self.changed:
            self.cancelled = True
            self.open.clear()
            self.changed.notify_all()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
