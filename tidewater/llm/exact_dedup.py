"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the digest, with the number of its buckets
beside it. A batch of documents is reduced to one row per digest (map-side combined, so a group
of copies that holds a third of all rows costs one row per map task), anti-joined with the index by
a sort-merge join of co-bucketed tables, and what is new is appended. Everything runs in the JVM.

Each row of the index carries the batch that brought it. A batch that is added again under its
name (after a lost driver, say) is compared with the other batches only, and its rows replace the
ones of the first attempt, whether that was whole or not. compact() writes each bucket as one file again.

Defined results:
  null text            counts as the empty text
  equal texts          identical after each run of [\\x20\\x09-\\x0D] became one space
  which row stays      the smallest doc_id; null ids come after all others; of rows that
                       repeat one id, the first in the order of the input's files
  a known digest       every row of it in a later batch is dropped, keep_id is the index's
  a repeated batch     the same result and the same index as after the first time
  other bucket count   the index keeps the one that it was made with; asking for another raises
  empty table          no rows
  extra columns        are not read; clashing names do not matter
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import scratch_path, settle
from tidewater.scratch import drop_path, exists

SPACES = "[\\x20\\x09-\\x0D]+"
COLUMNS = "digest BINARY, keep_id BIGINT, first_row BIGINT, copies BIGINT, batch STRING"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A bucketed, sorted table of digests at a path; opening the path again finds what was kept there.

    One batch is added at a time. Under path, `current` names the folder of the table as it is, and the number
    of its buckets; a batch or a compaction that breaks off leaves it at the table before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: list[str] = []
        known = self._current()
        if known is None:
            self.buckets, self.place = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"{self.path}/digests"
            self._point()
        else:
            self.buckets, self.place = known
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        self.name = self._open(self.place)

    def _current(self) -> tuple[int, str] | None:
        """Number of buckets and folder, as the newest file of `current` says; each is written whole under a name of its own."""
        if not exists(self.spark, f"{self.path}/current"):
            return None
        row = self.spark.read.schema("turn long, buckets int, folder string").json(f"{self.path}/current").orderBy(F.desc("turn")).first()
        return row and (row["buckets"], f"{self.path}/{row['folder']}")

    def _point(self) -> None:
        """Makes self.place the table."""
        turn = 0
        if exists(self.spark, f"{self.path}/current"):
            turn = 1 + (self.spark.read.schema("turn long").json(f"{self.path}/current").agg(F.max("turn")).first()[0] or 0)
        row = [(turn, self.buckets, self.place.rpartition("/")[2])]
        self.spark.createDataFrame(row, "turn long, buckets int, folder string").coalesce(1).write.mode("append").json(f"{self.path}/current")

    def _open(self, path: str) -> str:
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        self.tables.append(name)
        return name

    def close(self) -> None:
        """Takes the names out of the catalog; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _files(self) -> DataFrame:
        """The same rows as plain files: dealing out a bucketed table by its buckets, Spark would leave each file's rows where they are."""
        return self.spark.read.schema(self.rows().schema).parquet(self.place)

    def _rewrite(self, rows: DataFrame) -> None:
        """Puts rows in place of the table, a file per bucket; the old files go once the new ones are the table."""
        old, self.place = self.place, f"{self.path}/digests-{uuid.uuid4().hex}"
        name = self._open(self.place)
        rows.repartition(self.buckets, "digest").write.insertInto(name)
        self._point()
        self.name = name
        drop_path(self.spark, old)

    def compact(self) -> None:
        """Writes each bucket as one sorted file; every batch adds a file to each bucket that it has rows for."""
        if not self.rows().isEmpty():
            self._rewrite(self._files())

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch; returns per row doc_id, keep_id, group_size, kept, text_sha256.

        group_size counts the equal rows of this batch. A batch with a name can be added again,
        and gives what it gave the first time.
        """
        repeated = batch is not None and not self.rows().where(F.col("batch") == batch).isEmpty()
        batch = batch or uuid.uuid4().hex
        if repeated:
            self._rewrite(self._files().where(F.col("batch") != batch))
        seen = settle(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        name = self._open(scratch_path(self.spark, "batch"))
        groups = seen.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
        groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("first_row"), "copies", F.lit(batch).alias("batch")).write.insertInto(name)

        new, known = self.spark.table(name), self.rows()
        old = known.select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        fate = settle(
            new.join(old.hint("merge"), "digest", "left").select(
                "digest",
                F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.when(F.col("old").isNull(), F.col("first_row")).alias("first_row"),
                "copies",
            ),
            "fate",
        )
        new.join(known.hint("merge"), "digest", "left_anti").write.insertInto(self.name)
        self.spark.sql(f"DROP TABLE {name}")
        self.tables.remove(name)

        # Both sides are plain tables, so the join shuffles both and AQE can split a hot digest.
        return seen.join(fate.hint("merge"), "digest").select(
            "doc_id",
            "keep_id",
            F.col("copies").alias("group_size"),
            F.coalesce(F.col("row") == F.col("first_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """One batch against the index at path (a new, empty one by default)."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or scratch_path(spark, "index"), buckets)
    out = index.add(docs, batch)
    index.close()
    return out
