import threading
import time
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import extensions, scalar
from tidewater.operators import relational as ops
from tidewater.plans.builder import Plan, Task, TaskCancelled
from tidewater.sources import rowtext, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return sorted(rows(df), key=repr)


@pytest.fixture
def grouped(spark):
    return tables.values(spark, [(1, 10), (1, 20), (2, 30), (2, 40), (3, 50), (3, 60)], "k bigint, v bigint")


AGGS = ["sum(v) AS s", "count(1) AS n", "avg(v) AS a"]


def test_single_partial_and_intermediate_agree(spark, grouped):
    expected = [(1, 30, 2, 15.0), (2, 70, 2, 35.0), (3, 110, 2, 55.0)]
    assert bag(ops.aggregate(grouped, ["k"], AGGS)) == expected
    spread = Plan(grouped).local_partition(3)
    assert bag(spread.partial_aggregation(["k"], AGGS).final_aggregation(["k"], AGGS).df) == expected
    assert bag(spread.partial_aggregation(["k"], AGGS).intermediate_aggregation(["k"], AGGS).final_aggregation(["k"], AGGS).df) == expected


def test_global_aggregate(spark):
    six = spark.range(1, 7).withColumnRenamed("id", "v")
    assert rows(ops.aggregate(six, [], AGGS)) == [(21, 6, 3.5)]
    assert rows(Plan(six).partial_aggregation([], AGGS).final_aggregation([], AGGS).df) == [(21, 6, 3.5)]


def test_partial_state_columns(spark, grouped):
    state = ops.partial_aggregate(grouped, ["k"], ["avg(v) AS a", "sum(v) AS s"])
    assert state.columns == ["k", "a_sum", "a_count", "s"]
    assert dict(state.dtypes)["a_sum"] == "double"


def test_empty_input(spark, grouped):
    none = grouped.where("k > 9")
    assert rows(ops.aggregate(none, [], AGGS)) == [(0, 0, 0.0)]
    assert rows(ops.aggregate(none, ["k"], AGGS)) == []
    assert rows(ops.partial_aggregate(none, [], AGGS)) == []
    assert rows(ops.final_aggregate(ops.partial_aggregate(none, [], AGGS), [], AGGS)) == [(0, 0, 0.0)]


def test_null_keys_group_and_null_arguments_do_not_count(spark):
    df = tables.values(spark, [(None, 1), (None, None), (1, None)], "k int, v bigint")
    assert bag(ops.aggregate(df, ["k"], ["sum(v) AS s", "count(v) AS n", "avg(v) AS a"])) == [(1, 0, 0, 0.0), (None, 1, 1, 1.0)]


def test_sums_are_exact_above_2_to_53(spark):
    df = tables.values(spark, [(2**60,), (1,)], "v bigint")
    assert rows(ops.aggregate(df, [], ["sum(v) AS s"])) == [(2**60 + 1,)]


@pytest.mark.parametrize("text", ["sum(v", "sum v", "median(v) AS m", "sum(v + 1) AS s", "sum(v) AS s, x"])
def test_bad_aggregates_raise(text):
    with pytest.raises(ValueError):
        ops.parse_aggregate(text)


def test_aggregate_text_is_case_insensitive():
    assert ops.parse_aggregate("count(1) as nation_cnt") == ("count", "1", "nation_cnt")


def test_two_joins(spark):
    probe = tables.values(spark, [(i,) for i in range(5)], "key bigint")
    first = tables.values(spark, [(i, f"R{i}") for i in range(4)], "key bigint, name string")
    second = tables.values(spark, [(i, f"C{i}") for i in range(1, 5)], "key bigint, name string")
    plan = Plan(probe).hash_join(["key"], ["key"], first, output=["probe.key AS join_key"])
    plan = plan.hash_join(["join_key"], ["key"], Plan(second), output=["join_key", "build.name AS r_name"])
    assert bag(plan.df) == [(1, "C1"), (2, "C2"), (3, "C3")]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_null_keys_never_match(spark, limit):
    left = tables.values(spark, [(None,), (1,)], "k int")
    right = tables.values(spark, [(None, "x"), (1, "y")], "k int, v string")
    assert rows(ops.hash_join(left, right, ["k"], ["k"], output=["build.v"], broadcast_bytes=limit)) == [("y",)]
    assert rows(ops.hash_join(left, right, ["k"], ["k"], "anti")) == [(None,)]


def test_broadcast_only_behind_a_size_check(spark, small):
    orders, customer = (tables.parquet(spark, small, t) for t in ("orders", "customer"))
    for limit, there in ((1, False), (1 << 30, True)):
        plan = Plan(ops.hash_join(orders, customer, ["o_custkey"], ["c_custkey"], broadcast_bytes=limit)).explain()
        assert ("BroadcastHashJoin" in plan) == there


def test_sorts(spark):
    week = tables.values(spark, [(3,), (None,), (7,), (1,)], "a int")
    assert rows(ops.order_by(week, ["a"])) == [(None,), (1,), (3,), (7,)]
    assert rows(ops.order_by(week, ["a desc"])) == [(7,), (3,), (1,), (None,)]
    assert rows(ops.top_n(week, ["a DESC"], 2)) == [(7,), (3,)]
    assert len(rows(ops.top_n(week, ["a"], -1))) == 4
    parts = ops.order_by(spark.range(0, 24, 1, 4).orderBy(F.rand(1)), ["id"], partial=True)
    for part in parts.rdd.glom().collect():
        assert [r.id for r in part] == sorted(r.id for r in part)
    odd = Plan(spark.range(24)).filter("id % 2 == 1").local_partition(4).order_by(["id"], partial=True).local_merge().order_by(["id"])
    assert rows(odd.df) == [(i,) for i in range(1, 24, 2)]
    with pytest.raises(ValueError):
        ops.order_by(week, ["a DOWN"])


@pytest.mark.parametrize("text", ["a > 1 b < 2", "nothing > 1", "a % 2", "1 < 2 < 3"])
def test_bad_predicates_raise(spark, text):
    with pytest.raises(PySparkException):
        ops.where(tables.values(spark, [(1,)], "a bigint"), text).collect()


def test_arithmetic(spark):
    df = tables.values(spark, [(2**31 - 1, -7, 7.9)], "i int, j int, d double")
    got = df.select(scalar.plus("i", 1), scalar.mod("j", 3), scalar.mod("d", 2), scalar.divide("i", 2), scalar.mod("j", F.lit(2.9))).first()
    assert tuple(got) == (2**31, -1, 1, (2**31 - 1) / 2, -1)
    for bad in (scalar.divide("i", 0), scalar.mod("i", 0)):
        with pytest.raises(PySparkException):
            df.select(bad).collect()


def test_arithmetic_on_doubles(spark):
    df = tables.values(spark, [(2**31 - 1, 1.5, 0.75)], "i int, d double, e double")
    got = df.select(scalar.plus("d", "e"), scalar.minus("d", "e"), scalar.multiply("d", "e"), scalar.plus("i", "d"), scalar.multiply("i", "i"))
    assert tuple(got.first()) == (2.25, 0.75, 1.125, 2**31 + 0.5, (2**31 - 1) ** 2)
    assert [t for _, t in got.dtypes] == ["double"] * 4 + ["bigint"]


def test_expressions_as_text(spark):
    df = tables.values(spark, [(2**31 - 1, 7.9, "ab", None, [1, 2, 3])], "i int, d double, s string, n int, `an array` array<int>")
    wanted = {
        "i + 1": 2**31, "plus(i, i)": 2**32 - 2, "minus(0, i) * 2": -(2**32) + 2, "-i": 1 - 2**31, "d % 2": 1, "mod(d, 2)": 1, "i / 2": (2**31 - 1) / 2, "d + 1": 8.9, "2 + 3 * 4 - 1": 13, "(2 + 3) * 4": 20,
        "substr(s, 0, 2)": "", "substr(s, 2, 0 - 1)": "b", "SUBSTR(s, 1, 9)": "ab", "i > 1": 1, "eq(s, 'ab')": 1, "(i > 1) + (d > 9)": 1, "n IS NULL": 1, "n is not null": 0, "i in (1, 2)": 0, "d between 7 and 8": 1,
        "not d > 7": 0, "s like 'a%'": 1, "s not like 'a%'": 0, "CASE WHEN d < 1 THEN 'x' ELSE upper(s) END": "AB", "case s when 'ab' then 1.5 end": 1.5, "cast(d as int)": 7, "CAST(d AS DECIMAL(4, 2))": Decimal("7.90"),
        "transform(`an array`, x -> x * 2)": [2, 4, 6], "filter(`an array`, (x, k) -> x > 1 and k < 2)": [2], "size(`an array`)": 3, "'it''s'": "it's", "null": None, "d > 7 or n > 1 and false": 1, "1": 1, "0.5": 0.5, "1e3": 1000.0, ".5D": 0.5, "2L + 1": 3,
        "datediff(DATE '2020-01-03', DATE '2020-01-01')": 2, "df.i": 2**31 - 1, "neq(i, 2) AND lte(d, 7.9)": 1,
    }
    got = ops.project(df.alias("df"), *(f"{t} AS c{k}" for k, t in enumerate(wanted))).first()
    assert dict(zip(wanted, got)) == wanted
    assert rows(ops.where(df, "eq(plus(i, 1), 2147483648)", "gt(d, 7)").select("s")) == [("ab",)]
    assert dict(ops.project(df, "i", "i + 1", "1 AS one").dtypes) == {"i": "int", "i + 1": "bigint", "one": "bigint"}


@pytest.mark.parametrize("text", ["", "i +", "(i", "i)", "i AS", "f(i", "case end", "cast(i", "i $ 1", "x -> x", "plus(i)", "i i", "1x", "1.5L", "transform(i, 1)", "in (1)"])
def test_bad_texts_raise(spark, text):
    with pytest.raises(PySparkException):
        ops.project(tables.values(spark, [(1,)], "i int"), text)


def test_text_functions(spark):
    df = tables.values(spark, [("straße",)], "s string")
    assert tuple(df.select(scalar.upper_ascii("s"), scalar.capitalise("s"), scalar.substr("s", 5, 2)).first()) == ("STRAßE", "Straße", "ße")


def test_arrays_with_captured_columns(spark):
    df = tables.values(spark, [([1, 2, 3, 4], 3), ([3, 1, 5, 6, 7], 4)], "a array<bigint>, b bigint")
    got = ops.project(df, "transform(a, x -> x * 2) AS t", "transform(a, x -> x + b) AS u", "filter(a, x -> x % 2 == 0) AS f", "filter(a, x -> x >= b) AS g")
    assert rows(got) == [([2, 4, 6, 8], [4, 5, 6, 7], [2, 4], [3, 4]), ([6, 2, 10, 12, 14], [7, 5, 9, 10, 11], [6], [5, 6, 7])]


def test_plugin_from_file(spark, tmp_path):
    place = tmp_path / "own_plugin.py"
    place.write_text("def register_extensions(spark):\n    spark.sql('CREATE OR REPLACE TEMPORARY FUNCTION seven() RETURNS BIGINT RETURN 7L')\n")
    extensions.load_extensions(spark, str(place))
    assert rows(spark.range(2).selectExpr("seven()")) == [(7,), (7,)]
    with pytest.raises(AttributeError):
        extensions.load_extensions(spark, str(place), "missing")
    with pytest.raises(FileNotFoundError):
        extensions.load_extensions(spark, str(tmp_path / "none.py"))


def test_task_over_splits(spark, tmp_path):
    task = Task(spark, lambda paths: rowtext.read(spark, paths))
    for k, ids in enumerate(([1, 2, 3], [4, 5, 6])):
        path = str(tmp_path / f"split{k}.rv")
        with open(path, "w") as file:
            file.write("# schema: id:BIGINT,count:INTEGER,name:VARCHAR\n" + "".join(f"{i}\t{10 * i}\tn{i}\n" for i in ids))
        task.add_split(path)
    task.no_more_splits()
    with pytest.raises(RuntimeError):
        task.add_split("late")
    found = []
    while (row := task.next()) is not None:
        found.append(tuple(row))
    assert sorted(found) == [(i, 10 * i, f"n{i}") for i in range(1, 7)]


def test_pushdown_and_pruning_reach_the_scan(spark, small):
    plan = Plan(tables.lineitem(spark, small, ["l_revenue"])).filter("l_revenue > 5").explain()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_extendedprice" in read and "l_tax" not in read
    filtered = Plan(tables.parquet(spark, small, "lineitem")).filter("l_quantity < 24").project("l_tax").explain()
    assert "LessThan(l_quantity,24" in filtered


def test_top_n_does_not_sort_everything(spark, small):
    assert "TakeOrderedAndProject" in Plan(tables.parquet(spark, small, "orders")).top_n(["o_totalprice DESC"], 3).explain()


def test_task_can_be_cancelled(spark):
    def slow(batches):
        import time

        for batch in batches:
            time.sleep(0.2)
            yield batch

    task = Task(spark, lambda _: spark.range(0, 400, 1, 400).mapInArrow(slow, "id bigint"))
    task.no_more_splits()
    timer = threading.Timer(2, task.cancel)
    timer.start()
    began = time.monotonic()
    with pytest.raises(TaskCancelled):
        while task.next() is not None:
            pass
    assert time.monotonic() - began < 40
    assert spark.range(3).count() == 3


def test_cancel_interrupts_one_long_partition(spark):
    def slow(batches):
        import time

        time.sleep(60)
        yield from batches

    task = Task(spark, lambda _: spark.range(0, 10, 1, 1).mapInArrow(slow, "id bigint"))
    task.no_more_splits()
    threading.Timer(2, task.cancel).start()
    began = time.monotonic()
    with pytest.raises(TaskCancelled):
        task.next()
    assert time.monotonic() - began < 20
    with pytest.raises(TaskCancelled):
        task.next()
    assert spark.range(3).count() == 3


def _split(path, ids):
    path.write_text("# schema: id:BIGINT\n" + "".join(f"{i}\n" for i in ids))
    return str(path)


def test_each_scan_of_a_task_has_its_own_splits(spark, tmp_path):
    def build(splits):
        left, right = (rowtext.read(spark, splits[s]) for s in ("probe", "build"))
        return ops.hash_join(left, right, ["id"], ["id"], output=["probe.id AS id"])

    task = Task(spark, build, scans=("probe", "build"))
    task.add_split(_split(tmp_path / "a", [1, 2, 3]), "probe")
    task.add_split(_split(tmp_path / "b", [4, 5]), "probe")
    task.no_more_splits("probe")
    task.add_split(_split(tmp_path / "c", [2, 5, 7]), "build")
    with pytest.raises(RuntimeError):
        task.add_split("late", "probe")
    with pytest.raises(ValueError):
        task.add_split("lost")
    task.no_more_splits("build")
    assert sorted(iter(task.next, None)) == [(2,), (5,)]


def test_rows_come_before_the_last_split(spark, tmp_path):
    task = Task(spark, lambda paths: ops.where(rowtext.read(spark, paths), "id % 2 == 1"), row_by_row=True)
    task.add_split(_split(tmp_path / "a", [1, 2]))
    assert tuple(task.next()) == (1,)
    task.add_split(_split(tmp_path / "b", [4, 5]))
    assert tuple(task.next()) == (5,)
    threading.Timer(1, task.no_more_splits).start()
    assert task.next() is None


def test_aggregates_are_found_in_either_case(spark):
    extensions.register_aggregate("Latest", extensions.Aggregate(lambda x: {"": F.max(x)}, lambda _, s: F.max(s), lambda s: s[""]))
    df = tables.values(spark, [(1, 5), (1, 9)], "k int, v int")
    assert rows(ops.aggregate(df, ["k"], ["Latest(v) AS l", "latest(v) AS m"])) == [(1, 9, 9)]


def test_gathering_does_not_collapse_the_producers(spark):
    assert ops.gather(spark.range(0, 100, 1, 8)).rdd.getNumPartitions() == 1
    assert "Exchange" in Plan(ops.gather(spark.range(0, 100, 1, 8))).explain()


def test_users_own_operator(spark):
    def double(batches):
        for frame in batches:
            yield frame * 2

    assert rows(Plan(spark.range(3)).apply(lambda df: df.mapInPandas(double, df.schema)).order_by(["id"]).df) == [(0,), (2,), (4,)]


def test_registered_function_in_a_filter(spark):
    extensions.register_function(spark, "half_of", lambda x: x // 2, "bigint")
    assert rows(ops.where(spark.range(6), "half_of(id) == 2")) == [(4,), (5,)]
