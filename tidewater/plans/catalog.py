"""The registered queries over the Parquet tables and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import extensions, scalar
from tidewater.operators import relational as ops
from tidewater.plans.builder import Plan
from tidewater.scratch import scratch_path
from tidewater.sources import paged, rowtext, tables, typed_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def lineitem(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "lineitem", columns)


# Prices have two decimals: sums of decimals are exact, whatever the order of rows.
PRICE, DISCOUNT, TAX = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))"


# --- TPC-H ------------------------------------------------------------------------------


@query(f"""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum({PRICE}) AS DOUBLE) AS sum_base_price,
           CAST(sum({PRICE} * (1 - {DISCOUNT})) AS DOUBLE) AS sum_disc_price,
           CAST(sum({PRICE} * (1 - {DISCOUNT}) * (1 + {TAX})) AS DOUBLE) AS sum_charge,
           sum(l_quantity) / count(*) AS avg_qty, CAST(sum({PRICE}) AS DOUBLE) / count(*) AS avg_price,
           CAST(sum({DISCOUNT}) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
""")
def q1_pricing_summary(spark, sf_dir):
    items = ops.where(lineitem(spark, sf_dir), "l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    exact = ops.project(
        items,
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        f"{PRICE} AS price",
        f"{DISCOUNT} AS disc",
        f"{PRICE} * (1 - {DISCOUNT}) AS disc_price",
        f"{PRICE} * (1 - {DISCOUNT}) * (1 + {TAX}) AS charge",
    )
    sums = ops.aggregate(
        exact,
        ["l_returnflag", "l_linestatus"],
        ["sum(l_quantity) AS sum_qty", "sum(price) AS p", "sum(disc_price) AS dp", "sum(charge) AS c", "sum(disc) AS d", "count(1) AS count_order"],
    )
    result = ops.project(
        sums,
        "l_returnflag",
        "l_linestatus",
        "sum_qty",
        "CAST(p AS DOUBLE) AS sum_base_price",
        "CAST(dp AS DOUBLE) AS sum_disc_price",
        "CAST(c AS DOUBLE) AS sum_charge",
        "sum_qty / count_order AS avg_qty",
        "CAST(p AS DOUBLE) / count_order AS avg_price",
        "CAST(d AS DOUBLE) / count_order AS avg_disc",
        "count_order",
    )
    return ops.order_by(result, ["l_returnflag", "l_linestatus"])


def _revenue(spark, sf_dir, year):
    items = ops.where(
        lineitem(spark, sf_dir),
        f"l_shipdate >= TIMESTAMP_NTZ '{year}-01-01 00:00:00'",
        f"l_shipdate < TIMESTAMP_NTZ '{year + 1}-01-01 00:00:00'",
        "l_discount >= 0.05D",
        "l_discount <= 0.07D",
        "l_quantity < 24",
    )
    total = ops.aggregate(ops.project(items, f"{PRICE} * {DISCOUNT} AS r"), [], ["sum(r) AS r"])
    return ops.project(total, "CAST(r AS DOUBLE) AS revenue")


_Q6 = f"""
    SELECT coalesce(CAST(sum({PRICE} * {DISCOUNT}) AS DOUBLE), 0) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '%d-01-01' AND l_shipdate < TIMESTAMP '%d-01-01'
      AND l_discount >= CAST(0.05 AS DOUBLE) AND l_discount <= CAST(0.07 AS DOUBLE) AND l_quantity < 24
"""


@query(_Q6 % (1994, 1995))
def q6_revenue_1994(spark, sf_dir):
    return _revenue(spark, sf_dir, 1994)


@query(_Q6 % (1996, 1997))
def q6_revenue_1996(spark, sf_dir):
    return _revenue(spark, sf_dir, 1996)


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def nations_per_region(spark, sf_dir):
    nation = tables.parquet(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = tables.parquet(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    plan = Plan(nation).hash_join(["n_regionkey"], ["r_regionkey"], region).single_aggregation(["r_name"], ["count(1) AS nations"])
    return plan.order_by(["r_name"]).df


# --- scans ------------------------------------------------------------------------------


@query("SELECT l_tax, l_orderkey, l_returnflag FROM lineitem")
def scan_project(spark, sf_dir):
    return lineitem(spark, sf_dir, "l_tax", "l_orderkey", "l_returnflag")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_nation(spark, sf_dir):
    return ops.project(tables.parquet(spark, sf_dir, "nation"), "CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name", "CAST(n_regionkey AS BIGINT) AS n_regionkey")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def scan_region(spark, sf_dir):
    return ops.project(tables.parquet(spark, sf_dir, "region"), "CAST(r_regionkey AS BIGINT) AS r_regionkey", "r_name")


_REGIONS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(tables.REGIONS))
_NATIONS = ", ".join(f"({k}, '{n}', {r})" for k, (n, r) in enumerate(tables.NATIONS))


@query(f"""
    SELECT r.name AS r_name, count(*) AS nations FROM (VALUES {_NATIONS}) n(k, name, region) JOIN (VALUES {_REGIONS}) r(k, name) ON n.region = r.k GROUP BY r.name
""")
def scan_fixed_tables(spark, sf_dir):
    return Plan(tables.nation(spark)).hash_join(["n_regionkey"], ["r_regionkey"], tables.region(spark)).single_aggregation(["r_name"], ["count(1) AS nations"]).df


@query("""
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS l_shipdate, l_extendedprice * l_discount AS l_revenue,
           l_extendedprice * (1 - l_discount) AS l_disc_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge FROM lineitem
""")
def scan_derived(spark, sf_dir):
    derived = tables.with_derived(lineitem(spark, sf_dir))
    return ops.project(derived, "l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_shipdate", "l_revenue", "l_disc_price", "l_charge")


_WEEK = [(i, 5 * i, d) for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))]
_WEEK_SQL = "(VALUES " + ", ".join(f"({a}, {b}, '{d}')" for a, b, d in _WEEK) + ") t(a, b, dow)"


def _week(spark):
    return tables.values(spark, _WEEK, "a bigint, b bigint, dow string")


@query(f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, dow, CAST(a + b AS BIGINT) AS total FROM {_WEEK_SQL}")
def values_inline(spark, sf_dir):
    return ops.project(_week(spark), "a", "b", "dow", scalar.plus("a", "b").alias("total"))


# --- filters ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def filter_mod(spark, sf_dir):
    return Plan(tables.parquet(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])).filter("o_orderkey % 2 == 0").df


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag = 'R' AND l_orderkey % 3 <> 1")
def filter_chain(spark, sf_dir):
    plan = Plan(lineitem(spark, sf_dir)).filter("l_quantity >= 10").filter("l_quantity < 40").filter("l_returnflag == 'R'").filter("l_orderkey % 3 != 1")
    return plan.project("l_orderkey", "l_quantity").df


@query("""
    SELECT 'eq' AS op, count(*) AS n FROM part WHERE p_size = 10 UNION ALL SELECT 'neq', count(*) FROM part WHERE p_size <> 10
    UNION ALL SELECT 'lt', count(*) FROM part WHERE p_size < 10 UNION ALL SELECT 'gt', count(*) FROM part WHERE p_size > 10
    UNION ALL SELECT 'lte', count(*) FROM part WHERE p_size <= 10 UNION ALL SELECT 'gte', count(*) FROM part WHERE p_size >= 10
""")
def filter_each_cmp(spark, sf_dir):
    part = tables.parquet(spark, sf_dir, "part", ["p_size"])
    kinds = ("eq", "neq", "lt", "gt", "lte", "gte")
    counts = ops.aggregate(part.select(*(scalar.compare(k, "p_size", 10).alias(k) for k in kinds)), [], [f"sum({k}) AS {k}" for k in kinds])
    return counts.unpivot([], list(kinds), "op", "n")


# --- expressions ------------------------------------------------------------------------


@query("""
    SELECT p_partkey, p_partkey + p_size AS added, p_partkey - p_size AS taken, p_partkey * p_size AS times, CAST(p_size AS BIGINT) * 2 + p_partkey % 3 AS mixed FROM part
""")
def expr_arith(spark, sf_dir):
    part = tables.parquet(spark, sf_dir, "part", ["p_partkey", "p_size"])
    mixed = scalar.plus(scalar.multiply("p_size", 2), scalar.mod("p_partkey", 3))
    return part.select(
        "p_partkey",
        scalar.plus("p_partkey", "p_size").alias("added"),
        scalar.minus("p_partkey", "p_size").alias("taken"),
        scalar.multiply("p_partkey", "p_size").alias("times"),
        mixed.alias("mixed"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS added, l_extendedprice - l_discount AS taken, l_extendedprice * l_discount AS times,
           CAST(l_linenumber AS BIGINT) + l_discount AS mixed, l_tax * 2 AS doubled FROM lineitem
""")
def expr_arith_double(spark, sf_dir):
    items = lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        scalar.plus("l_quantity", "l_tax").alias("added"),
        scalar.minus("l_extendedprice", "l_discount").alias("taken"),
        scalar.multiply("l_extendedprice", "l_discount").alias("times"),
        scalar.plus("l_linenumber", "l_discount").alias("mixed"),
        scalar.multiply("l_tax", 2).alias("doubled"),
    )


@query("""
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) + 2147483647 AS sum_wide, CAST(l_linenumber AS BIGINT) * 2147483647 AS times_wide, l_quantity - 0.5::DOUBLE AS less,
           CAST(trunc(l_extendedprice) AS BIGINT) % 7 AS rest, CAST(l_partkey AS DOUBLE) / l_linenumber AS share,
           CAST(l_linenumber = 3 AS INTEGER) AS third, CAST(l_linenumber >= 3 AS INTEGER) + CAST(2 AS BIGINT) AS counted,
           CASE WHEN l_linenumber - 2 <= 0 THEN '' ELSE substring(l_returnflag || l_linestatus || 'xyz', CAST(l_linenumber - 2 AS INTEGER), 2) END AS part,
           upper(l_linestatus || '-' || l_returnflag) AS status
    FROM lineitem
""")
def expr_text_functions(spark, sf_dir):
    items = lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    return ops.project(
        items,
        "l_orderkey",
        "plus(l_linenumber, 2147483647) AS sum_wide",
        "l_linenumber * 2147483647 AS times_wide",
        "minus(l_quantity, 0.5) AS less",
        "l_extendedprice % 7.9 AS rest",
        "divide(l_partkey, l_linenumber) AS share",
        "eq(l_linenumber, 3) AS third",
        "(l_linenumber >= 3) + 2 AS counted",
        "substr(concat(l_returnflag, l_linestatus, 'xyz'), l_linenumber - 2, 2) AS part",
        "upper(concat(l_linestatus, '-', l_returnflag)) AS status",
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_linenumber <> 2 AND l_quantity + l_linenumber < 30 AND CAST(trunc(l_extendedprice) AS BIGINT) % 2 = 1 AND CAST(l_linenumber AS BIGINT) * 2147483647 > 2147483647
""")
def filter_text_functions(spark, sf_dir):
    plan = Plan(lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    plan = plan.filter("neq(l_linenumber, 2)").filter("lt(plus(l_quantity, l_linenumber), 30)").filter("mod(l_extendedprice, 2.9) == 1").filter("gt(l_linenumber * 2147483647, 2147483647)")
    return plan.project("l_orderkey", "l_linenumber", "l_quantity").df


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) / p_size AS share FROM part")
def expr_divide(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "part", ["p_partkey", "p_size"]).select("p_partkey", scalar.divide("p_partkey", "p_size").alias("share"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) % 7 AS rest, CAST(trunc(c_acctbal) AS BIGINT) % CAST(trunc(CAST(3.9 AS DOUBLE)) AS BIGINT) AS rest_fraction FROM customer")
def expr_mod_double(spark, sf_dir):
    customer = tables.parquet(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return customer.select("c_custkey", scalar.mod("c_acctbal", 7).alias("rest"), scalar.mod("c_acctbal", F.lit(3.9)).alias("rest_fraction"))


@query("""
    SELECT s_suppkey, CAST(s_acctbal = 0 AS INTEGER) AS eq, CAST(s_acctbal <> 0 AS INTEGER) AS neq, CAST(s_acctbal < s_suppkey AS INTEGER) AS lt,
           CAST(s_acctbal > 1000 AS INTEGER) AS gt, CAST(s_nationkey <= 12 AS INTEGER) AS lte, CAST(s_nationkey >= 12 AS INTEGER) AS gte FROM supplier
""")
def expr_cmp_int(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "supplier").select(
        "s_suppkey",
        scalar.compare("eq", "s_acctbal", 0).alias("eq"),
        scalar.compare("neq", "s_acctbal", 0).alias("neq"),
        scalar.compare("lt", "s_acctbal", "s_suppkey").alias("lt"),
        scalar.compare("gt", "s_acctbal", 1000).alias("gt"),
        scalar.compare("lte", "s_nationkey", 12).alias("lte"),
        scalar.compare("gte", "s_nationkey", 12).alias("gte"),
    )


def _substr_sql(s: str, start: str, length: str) -> str:
    return f"CASE WHEN {start} <= 0 OR {start} > length({s}) THEN '' WHEN {length} < 0 THEN substring({s}, {start}) ELSE substring({s}, {start}, {length}) END"


@query(f"SELECT p_partkey, {_substr_sql('p_name', '2', '4')} AS part_name, {_substr_sql('p_type', '1', '3')} AS part_type FROM part")
def expr_substr(spark, sf_dir):
    part = tables.parquet(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"])
    return part.select("p_partkey", scalar.substr("p_name", 2, 4).alias("part_name"), scalar.substr("p_type", 1, 3).alias("part_type"))


_EDGES = [("abcdef", s, n) for s, n in ((0, 2), (-2, 2), (2, -1), (1, 100), (6, 1), (7, 1), (3, 0), (1, 6))]


@query(f"SELECT CAST(k AS INTEGER) AS start, CAST(n AS INTEGER) AS length, {_substr_sql('s', 'k', 'n')} AS part FROM (VALUES " + ", ".join(f"('{s}', {k}, {n})" for s, k, n in _EDGES) + ") t(s, k, n)")
def expr_substr_edges(spark, sf_dir):
    edges = tables.values(spark, _EDGES, "s string, start int, length int")
    return edges.select("start", "length", scalar.substr("s", "start", "length").alias("part"))


@query("SELECT c_custkey, upper(c_name) AS name FROM customer")
def expr_upper(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select("c_custkey", F.upper("c_name").alias("name"))


@query("SELECT c_custkey, c_name || c_mktsegment AS both FROM customer")
def expr_concat(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", F.concat("c_name", "c_mktsegment").alias("both"))


@query("SELECT p_partkey, upper(substring(p_type, 1, 1)) || substring(p_type, 2) AS capital FROM part WHERE length(p_type) > 1")
def expr_capitalize(spark, sf_dir):
    return ops.where(tables.parquet(spark, sf_dir, "part"), "length(p_type) > 1").select("p_partkey", scalar.capitalise("p_type").alias("capital"))


# --- arrays: returned as text, so that every engine compares them alike -----------------


def _arrays(spark, sf_dir):
    return lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("a", F.array("l_orderkey", "l_partkey", "l_suppkey"))


def _array_query(expression):
    return lambda spark, sf_dir: ops.project(_arrays(spark, sf_dir), "l_orderkey", "l_linenumber", f"array_join({expression}, ',') AS r")


for _name, _spark, _duck in (
    ("array_transform", "transform(a, x -> x * 2)", "list_transform(a, lambda x: x * 2)"),
    ("array_filter", "filter(a, x -> x % 2 == 0)", "list_filter(a, lambda x: x % 2 = 0)"),
    ("array_transform_capture", "transform(a, x -> x + l_linenumber)", "list_transform(a, lambda x: x + l_linenumber)"),
    ("array_filter_capture", "filter(a, x -> x >= l_partkey)", "list_filter(a, lambda x: x >= l_partkey)"),
):
    QUERIES[_name] = _array_query(_spark)
    ORACLES[_name] = f"SELECT l_orderkey, l_linenumber, array_to_string({_duck}, ',') AS r FROM (SELECT *, [l_orderkey, l_partkey, l_suppkey] AS a FROM lineitem)"


# --- aggregation ------------------------------------------------------------------------


@query("SELECT sum(l_quantity) AS q, CAST(sum(l_partkey) AS BIGINT) AS k, count(*) AS n, sum(l_quantity) / count(l_quantity) AS a FROM lineitem")
def agg_global(spark, sf_dir):
    return ops.aggregate(lineitem(spark, sf_dir, "l_quantity", "l_partkey"), [], ["sum(l_quantity) AS q", "sum(l_partkey) AS k", "count(1) AS n", "avg(l_quantity) AS a"])


@query("SELECT l_suppkey, sum(l_quantity) AS q, count(l_partkey) AS n, sum(l_quantity) / count(*) AS a FROM lineitem GROUP BY l_suppkey")
def agg_group(spark, sf_dir):
    return ops.aggregate(lineitem(spark, sf_dir, "l_suppkey", "l_quantity", "l_partkey"), ["l_suppkey"], ["sum(l_quantity) AS q", "count(l_partkey) AS n", "avg(l_quantity) AS a"])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, l_tax, CAST(sum(l_orderkey) AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_group_multi(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]
    return ops.aggregate(lineitem(spark, sf_dir), keys, ["sum(l_orderkey) AS k", "count(1) AS n"])


@query("SELECT coalesce(CAST(sum(o_custkey) AS BIGINT), 0) AS s, coalesce(avg(o_totalprice), 0) AS a, count(*) AS n FROM orders WHERE o_orderkey < 0")
def agg_empty_global(spark, sf_dir):
    return ops.aggregate(ops.where(tables.parquet(spark, sf_dir, "orders"), "o_orderkey < 0"), [], ["sum(o_custkey) AS s", "avg(o_totalprice) AS a", "count(1) AS n"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus")
def agg_empty_group(spark, sf_dir):
    return ops.aggregate(ops.where(tables.parquet(spark, sf_dir, "orders"), "o_orderkey < 0"), ["o_orderstatus"], ["count(1) AS n"])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def agg_keys_only(spark, sf_dir):
    return ops.aggregate(tables.parquet(spark, sf_dir, "part"), ["p_brand", "p_type"], [])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def agg_having(spark, sf_dir):
    return Plan(tables.parquet(spark, sf_dir, "orders")).single_aggregation(["o_orderpriority"], ["count(1) AS n"]).filter("n > 10").df


_STATE_SQL = "SELECT l_suppkey, sum(l_quantity) AS q, sum(l_quantity) / count(l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY l_suppkey"
_STATE = (["l_suppkey"], ["sum(l_quantity) AS q", "avg(l_quantity) AS a", "count(1) AS n"])


@query(_STATE_SQL)
def agg_partial_final(spark, sf_dir):
    return Plan(lineitem(spark, sf_dir, "l_suppkey", "l_quantity")).partial_aggregation(*_STATE).final_aggregation(*_STATE).df


@query(_STATE_SQL)
def agg_partial_intermediate_final(spark, sf_dir):
    plan = Plan(lineitem(spark, sf_dir, "l_suppkey", "l_quantity")).local_partition(4).partial_aggregation(*_STATE)
    return plan.intermediate_aggregation(*_STATE).local_merge(1).final_aggregation(*_STATE).df


@query("SELECT o_custkey % 5 AS k, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def agg_registered(spark, sf_dir):
    extensions.register_aggregate("latest", extensions.Aggregate(lambda x: {"": F.max(x)}, lambda _, s: F.max(s), lambda s: s[""]))
    orders = ops.project(tables.parquet(spark, sf_dir, "orders"), "o_custkey % 5 AS k", "o_orderkey")
    return ops.aggregate(orders, ["k"], ["latest(o_orderkey) AS latest"])


# --- joins ------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    return ops.where(tables.parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]), "o_totalprice > 450000")


def _customers(spark, sf_dir):
    return ops.where(tables.parquet(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]), "c_custkey % 4 != 0")


def _outer(how):
    def run(spark, sf_dir):
        output = ["probe.c_custkey", "probe.c_name"] + ([] if how == "anti" else ["build.o_orderkey", "build.o_totalprice"])
        return ops.hash_join(_customers(spark, sf_dir), _orders(spark, sf_dir), ["c_custkey"], ["o_custkey"], how, output=output)

    return run


_SIDES = "(SELECT * FROM customer WHERE c_custkey % 4 <> 0) c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c.c_custkey = o.o_custkey"
for _how in ("inner", "left", "right", "full", "anti"):
    QUERIES[f"join_{_how}"] = _outer(_how)
    _columns = "c_custkey, c_name" if _how == "anti" else "c_custkey, c_name, o_orderkey, o_totalprice"
    ORACLES[f"join_{_how}"] = f"SELECT {_columns} FROM {_SIDES.format(_how.upper())}"


@query("""
    SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal
""")
def join_residual(spark, sf_dir):
    customer, supplier = (tables.parquet(spark, sf_dir, t) for t in ("customer", "supplier"))
    return ops.hash_join(customer, supplier, ["c_nationkey"], ["s_nationkey"], residual="probe.c_acctbal < build.s_acctbal", output=["c_custkey", "s_suppkey"])


@query("""
    SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def join_chain(spark, sf_dir):
    orders, customer, nation, region = (tables.parquet(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    plan = Plan(orders).hash_join(["o_custkey"], ["c_custkey"], customer, output=["o_orderkey", "c_name", "c_nationkey"])
    plan = plan.hash_join(["c_nationkey"], ["n_nationkey"], nation, output=["o_orderkey", "c_name", "n_name", "n_regionkey"])
    return plan.hash_join(["n_regionkey"], ["r_regionkey"], region, output=["o_orderkey", "c_name", "n_name", "r_name"]).df


@query("""
    SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS other FROM lineitem a JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b
    ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
""")
def join_multi_key(spark, sf_dir):
    items = lineitem(spark, sf_dir, "l_orderkey", "l_linenumber")
    returned = ops.where(lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_returnflag == 'R'")
    keys = ["l_orderkey", "l_linenumber"]
    return ops.hash_join(items, returned, keys, keys, output=["probe.l_orderkey", "probe.l_linenumber", "build.l_quantity AS other"])


@query("SELECT p.k AS join_key, b.name AS r_name FROM (VALUES (1), (1), (2), (NULL)) p(k) JOIN (VALUES (1, 'a'), (1, 'b'), (NULL, 'c'), (3, 'd')) b(k, name) ON p.k = b.k")
def join_duplicates(spark, sf_dir):
    probe = tables.values(spark, [(1,), (1,), (2,), (None,)], "k int")
    build = tables.values(spark, [(1, "a"), (1, "b"), (None, "c"), (3, "d")], "k int, name string")
    return ops.hash_join(probe, build, ["k"], ["k"], output=["probe.k AS join_key", "build.name AS r_name"])


# --- sorts ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey NULLS FIRST")
def order_by(spark, sf_dir):
    return ops.order_by(tables.parquet(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), ["o_orderkey"])


@query("SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey DESC")
def order_by_desc_multi(spark, sf_dir):
    orders = tables.parquet(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice", "o_orderkey"])
    return ops.order_by(orders, ["o_orderpriority DESC", "o_totalprice", "o_orderkey DESC"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 ORDER BY o_orderkey")
def partial_then_final_sort(spark, sf_dir):
    plan = Plan(tables.parquet(spark, sf_dir, "orders", ["o_orderkey"])).filter("o_orderkey % 2 == 1").local_partition(4)
    return plan.order_by(["o_orderkey"], partial=True).local_merge(1).order_by(["o_orderkey"]).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, sf_dir):
    return ops.top_n(tables.parquet(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), ["o_totalprice DESC", "o_orderkey"], 25)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def top_n_zero(spark, sf_dir):
    return ops.top_n(tables.parquet(spark, sf_dir, "orders", ["o_orderkey"]), ["o_orderkey"], 0)


# --- files, written and read back -------------------------------------------------------


def _suppliers(spark, sf_dir):
    return ops.project(tables.parquet(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_name")


@query("SELECT s_suppkey, s_nationkey, s_name FROM supplier")
def rowtext_round_trip(spark, sf_dir):
    path = scratch_path(spark, "rowtext")
    rowtext.write(_suppliers(spark, sf_dir), path)
    return rowtext.read(spark, path)


@query("SELECT s_suppkey AS my_key, s_name || ', \"' || s_nationkey || '\"' AS name, s_nationkey AS score FROM supplier")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = ops.project(_suppliers(spark, sf_dir), "s_suppkey AS my_key", "concat(s_name, ', \"', s_nationkey, '\"') AS name", "s_nationkey AS score")
    quoted = ops.project(rows, "concat_ws(',', my_key, concat('\" ', replace(name, '\"', '\"\"'), ' \"'), score) AS value")
    types = tables.values(spark, [("BIGINT,VARCHAR,INTEGER",)], "value string")
    types.coalesce(1).unionByName(quoted).select(F.col("value").alias("my_key,name,score")).coalesce(1).write.options(
        header=True, sep="\u0001", quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return typed_csv.read(spark, path)


@query("SELECT l_orderkey AS id, l_returnflag AS label, l_linenumber AS price FROM lineitem WHERE l_orderkey > 5000 AND l_returnflag <> 'N' AND l_linenumber >= 2")
def paged_scan_filter(spark, sf_dir):
    path = scratch_path(spark, "paged")
    rows = ops.project(lineitem(spark, sf_dir), "l_orderkey AS id", "l_returnflag AS label", "l_linenumber AS price", "l_linestatus AS other")
    paged.write(rows, path, row_group=8192, page=1024)
    found = paged.read(spark, path, columns=["id", "label", "price"], filters=[("id", "GT", 5000), ("label", "NE", "N"), ("price", "GE", 2)])
    return ops.where(found, "id > 5000", "label != 'N'", "price >= 2")


@query("""
    WITH t AS (SELECT concat_ws('|', s_suppkey, s_name) AS first, '  ' || s_name || ' ' AS second, CAST(s_suppkey AS DOUBLE) / 4 AS share FROM supplier)
    SELECT first, second, share, CAST(2 * count(*) AS BIGINT) AS copies FROM t GROUP BY ALL
""")
def rowtext_append_round_trip(spark, sf_dir):
    path = scratch_path(spark, "rowtext")
    rows = ops.project(_suppliers(spark, sf_dir), "concat_ws('|', s_suppkey, s_name) AS first", "concat('  ', s_name, ' ') AS second", "s_suppkey / 4 AS share")
    rowtext.write(rows, path)
    rowtext.write(rows, path, mode="append", single=True)
    return ops.aggregate(rowtext.read(spark, path), ["first", "second", "share"], ["count(1) AS copies"])


@query("""
    WITH t AS (SELECT s_name AS first, 'VARCHAR' AS second FROM supplier UNION ALL SELECT 'VARCHAR', 'VARCHAR' FROM supplier WHERE s_suppkey <= 3)
    SELECT first AS "a, b", second AS "c", count(*) AS n FROM t GROUP BY ALL
""")
def csv_types_line_by_place(spark, sf_dir):
    """Two files of two columns named "a, b" and "c"; three rows read like the types line and are data."""
    path = scratch_path(spark, "csv")
    like_types = ops.where(tables.parquet(spark, sf_dir, "supplier", ["s_suppkey"]), "s_suppkey <= 3")
    plain = ops.project(_suppliers(spark, sf_dir), "concat(s_name, ',VARCHAR') AS value")
    for k, part in enumerate((plain, ops.project(like_types, "'VARCHAR,VARCHAR' AS value"))):
        types = tables.values(spark, [("VARCHAR,VARCHAR",)], "value string")
        lines = types.coalesce(1).unionByName(part).select(F.col("value").alias('"a, b",c')).coalesce(1)
        lines.write.options(header=True, sep="\u0001", quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{k}")
    read = typed_csv.read(spark, [f"{path}/0", f"{path}/1"])
    return read.groupBy("a, b", "c").agg(F.count(F.lit(1)).alias("n"))


# --- functions added at run time --------------------------------------------------------


@query("SELECT n_nationkey, CAST(123 AS BIGINT) AS d, CAST(n_regionkey * 2 AS BIGINT) AS twice FROM nation")
def udf_plugin(spark, sf_dir):
    extensions.load_extensions(spark, "tidewater.functions.sample_plugin")
    extensions.register_function(spark, "twice", lambda x: x * 2, "bigint")
    return ops.project(tables.parquet(spark, sf_dir, "nation"), "n_nationkey", "dynamic() AS d", "twice(CAST(n_regionkey AS BIGINT)) AS twice")


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS u FROM events GROUP BY event_type")
def user_operator(spark, sf_dir):
    def halves(batches):
        for batch in batches:  # an operator of the user's own, batch in and batches out
            middle = batch.num_rows // 2
            yield batch.slice(0, middle)
            yield batch.slice(middle)

    events = tables.parquet(spark, sf_dir, "events", ["event_type", "user_id"])
    plan = Plan(events).apply(lambda df: df.mapInArrow(halves, df.schema))
    return plan.single_aggregation(["event_type"], ["count(1) AS n", "sum(user_id) AS u"]).df
