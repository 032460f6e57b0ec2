"""CSV with a line of names and, as a rule, a second line of types.

The first file gives names and types; the scan holds the names of every other file against them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = "\u0001file"
TYPES = {"INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "VARCHAR": T.StringType()}


def read(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", has_types: bool = True) -> DataFrame:
    """Fields are trimmed, inside quotes too; "" in a quoted field is a quote; a wrong number of fields raises, and so do other names.

    Without a types line (the first file's second line doesn't consist of type names) all columns are VARCHAR.
    Only one line of each file is its types line: where all types are VARCHAR, other rows that
    read the same are data, which takes a second scan; with another type among them no row can read so.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    files = sorted(spark.read.text(paths).inputFiles())
    head = spark.read.csv(files[0], **options).head(2) if files else []
    if not head:
        raise ValueError(f"{paths[0]} has no header")
    own = [x or "" for x in head[0]]
    names = [x.strip() for x in own]
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in own])
    raw = spark.read.csv(paths, schema=raw_schema, header=True, mode="FAILFAST", enforceSchema=False, **options)
    kinds = [(x or "").strip() for x in head[1]] if len(head) > 1 and has_types else []
    typed = len(kinds) == len(names) and all(k in TYPES for k in kinds)
    rows = raw.select(*(F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(name) for n, name in zip(own, names)), F.col("_metadata.file_path").alias(_FILE))
    if not typed:
        return rows.drop(_FILE)
    is_types = F.lit(True)
    for n, k in zip(names, kinds):
        is_types = is_types & (F.col(f"`{n}`") == k)
    found = rows.where(~is_types).drop(_FILE)
    if set(kinds) == {"VARCHAR"}:
        alike = rows.where(is_types).groupBy(_FILE).agg(F.count(F.lit(1)).alias("n"))
        again = alike.select(F.explode(F.array_repeat(F.struct(*(F.lit(k).alias(n) for n, k in zip(names, kinds))), (F.col("n") - 1).cast("int"))).alias("row"))
        found = found.unionByName(again.select("row.*"))
    return found.select(*(F.col(f"`{n}`").cast(TYPES[k]).alias(n) for n, k in zip(names, kinds)))
