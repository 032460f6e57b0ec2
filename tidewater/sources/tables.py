"""Tables: inline rows, Parquet, the fixed nation and region tables, and line items with derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalar import date_key

# The 25 nations in the order of their keys with their region keys (MOROCCO is in region 4 here), and the regions.
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2),
    ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 4), ("MOZAMBIQUE", 0), ("PERU", 1),
    ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: The columns of a line item file made by dbgen, by place.
_DBGEN = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_revenue", "l_disc_price", "l_charge")


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows given in the program."""
    return spark.createDataFrame(list(rows), schema)


def parquet(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; the columns asked for, in that order (none: all). Unknown ones raise."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def nation(spark: SparkSession, columns: Sequence[str] = ()) -> DataFrame:
    rows = [(k, name, region) for k, (name, region) in enumerate(NATIONS)]
    df = values(spark, rows, "n_nationkey bigint, n_name string, n_regionkey bigint")
    return df.select(*columns) if columns else df


def region(spark: SparkSession, columns: Sequence[str] = ()) -> DataFrame:
    df = values(spark, list(enumerate(REGIONS)), "r_regionkey bigint, r_name string")
    return df.select(*columns) if columns else df


def with_derived(lineitem: DataFrame) -> DataFrame:
    """Line items with the date as yyyymmdd and the revenue, discounted price and charge."""
    discounted = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.withColumns(
        {
            "l_shipdate": date_key("l_shipdate"),
            "l_revenue": F.col("l_extendedprice") * F.col("l_discount"),
            "l_disc_price": discounted,
            "l_charge": discounted * (1 + F.col("l_tax")),
        }
    )


def lineitem(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """The Parquet line items with derived columns; the scan reads what the columns need."""
    return with_derived(parquet(spark, sf_dir, "lineitem")).select(*(columns or LINEITEM))


def lineitem_text(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """Line items of dbgen's "|"-separated text, split by byte ranges."""
    parts = F.split("value", "\\|", -1)
    kinds = {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date"}
    kinds |= {c: "double" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    raw = spark.read.text(path).select(*(parts[i].cast(kinds.get(c, "bigint")).alias(c) for i, c in enumerate(_DBGEN)))
    return with_derived(raw).select(*(columns or LINEITEM))
