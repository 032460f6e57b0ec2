"""Global shuffle of a corpus into shards by a two-pass external shuffle.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash of doc_id and text;
Spark's shuffle holds the buckets on disk, each as a partition of its own. Pass two loads one bucket at a
time, puts it in a canonical order, shuffles it with Fisher-Yates under a seed of its own and
writes it. The buckets in their order are one random permutation of the corpus; a shard is a contiguous
share of it, so shard sizes differ by one row at most (law "rows"). The seed and the rows
decide, not how the input is laid out.

Copies of a row (equal in doc_id and text) are numbered, and each BATCH of them is scattered by a hash of its own,
so no bucket outgrows memory however often a row is repeated. Numbers are given inside the parts of the
input and shifted by what the parts before hold, so no task sees all copies.

Where each bucket begins comes from a running sum in two levels over a table of bucket counts, and reaches the
bucket as a row among its records. The driver gathers two numbers about the input, and at most PREFIXES
hash prefixes of rows with more than BATCH copies.

Defined results:
  null text            written as null; its size is the 8 bytes every record has
  repeated rows        each keeps a place of its own
  very long texts      a bucket is as large as its records; one record is never split
  empty table          no rows, no files
  extra columns        are carried along; shard and slot are replaced
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import fresh, settle, ship

RECORD_BYTES = 8
#: Copies of a row that are scattered together; hash prefixes by which rows with more copies are told; buckets in a block of the running sum.
BATCH, PREFIXES, BLOCK = 1000, 4096, 4096


def record_size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _scattered(docs: DataFrame, mix: str, seed: int, batch: int) -> DataFrame:
    """docs with the column mix: a hash of the seed, the row and the number of its batch of copies."""
    copy = lambda key, number: F.xxhash64(F.lit(seed), key, F.floor(number / F.lit(batch)))
    keyed = docs.withColumn(mix, F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")))
    many = settle(keyed.groupBy(mix).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > batch).select(mix), "copies")
    prefix = F.pmod(F.col(mix), F.lit(PREFIXES)).cast("int")
    flagged = [r[0] for r in many.select(prefix).distinct().collect()]
    others = (keyed.where(~prefix.isin(flagged)) if flagged else keyed).withColumn(mix, copy(F.col(mix), F.lit(0)))
    if not flagged:
        return others
    part, place, before, n = (fresh(keyed, x) for x in ("part", "place", "before", "n"))
    some = settle(keyed.where(prefix.isin(flagged)).withColumn(part, F.spark_partition_id()), "flagged")  # written, as a second scan could deal rows to other parts
    counts = some.groupBy(mix, part).agg(F.count(F.lit(1)).alias(n))
    shift = F.sum(n).over(Window.partitionBy(mix).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    shifts = settle(counts.select(mix, part, F.coalesce(shift, F.lit(0)).alias(before)), "shifts")
    placed = some.withColumn(place, F.row_number().over(Window.partitionBy(mix, part).orderBy(F.lit(0))))
    number = F.col(before) + F.col(place) - 1
    numbered = placed.join(shifts.hint("merge"), [mix, part]).withColumn(mix, copy(F.col(mix), number)).select(*keyed.columns)
    return others.unionByName(numbered)


def _starts(counts: DataFrame) -> DataFrame:
    """bucket, start: the rows in the buckets before each bucket of counts (bucket, n)."""
    blocks = counts.groupBy(F.floor(F.col("bucket") / BLOCK).alias("block")).agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each BLOCK buckets
    blocks = blocks.select("block", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK)).select("bucket", "block", F.coalesce(inside, F.lit(0)).alias("inside"))
    return within.join(blocks, "block").select("bucket", (F.col("ahead") + F.col("inside")).alias("start"))


def shuffle(docs: DataFrame, path: str, shards: int = 24, seed: int = 20, bucket_bytes: int = 32 << 20, batch: int = BATCH) -> DataFrame:
    """Writes the shards to path/shard=K as Parquet in slot order; returns the written table with shard and slot."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("shard", "slot")
    mix, bucket, start = (fresh(docs, x) for x in ("mix", "bucket", "start"))
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(record_size(F.col("text")))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = _scattered(docs, mix, seed, batch).withColumn(bucket, F.pmod(mix, F.lit(buckets)).cast("int"))
    counts = settle(scattered.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    firsts = np.array([-(-s * rows // shards) for s in range(shards + 1)], dtype=np.int64)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    heads = _starts(counts).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields), F.lit(None).cast("long").alias(mix), F.col("bucket").alias(bucket), F.col("start").alias(start)
    )
    dealt = scattered.withColumn(start, F.lit(None).cast("long")).unionByName(heads)
    dealt = dealt.repartitionById(buckets, F.col(bucket)).sortWithinPartitions(bucket)

    def fisher_yates(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The records of a whole bucket, one row of which says where the bucket begins."""
        whole = pa.Table.from_batches(parts)
        b, first = whole[bucket][0].as_py(), pc.max(whole[start]).as_py()
        whole = whole.filter(pc.is_null(whole[start]))
        keys = pa.table({"m": whole[mix], "i": whole["doc_id"], "t": pc.binary_length(whole["text"])})
        order = pc.sort_indices(keys, sort_keys=[("m", "ascending"), ("i", "ascending"), ("t", "ascending")]).to_pylist()
        random = np.random.default_rng([seed, b])
        below = (random.random(len(order) - 1) * np.arange(len(order), 1, -1)).astype(np.int64).tolist()
        for i, j in zip(range(len(order) - 1, 0, -1), below):
            order[i], order[j] = order[j], order[i]
        at = first + np.arange(len(order), dtype=np.int64)
        shard = np.searchsorted(firsts, at, side="right") - 1
        out = whole.drop([mix, bucket, start]).take(pa.array(order))
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(at - firsts[shard], pa.int64()))

    def run(batches):
        """Rows come sorted by bucket; one that goes on in the next batch is carried over."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = np.asarray(batch.column(bucket))
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[0].column(bucket)[0].as_py() != ids[a]:
                    yield from fisher_yates(held).to_batches()
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from fisher_yates(held).to_batches()

    dealt.mapInArrow(run, schema).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def digests(sharded: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of written shards."""
    return sharded.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
