import struct

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater import scratch
from tidewater.plans import catalog
from tidewater.sources import paged, paged_format, registry, rowtext, tables, typed_csv
from tidewater.streaming import splits

LABELS = ["alpha", "beta", "gamma", "delta", "skip", "omega", "pi", "tau", "sigma", "zeta"]


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rowtext_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tables.values(spark, [(1, 10, "a", 0.1), (2, 20, "", 1e300), (3, 30, "# x", -0.0), (4, 1, ' "q" ', 2.0)], "id bigint, count int, name string, d double")
    rowtext.write(df, path)
    assert bag(rowtext.read(spark, path)) == bag(df)
    assert rowtext.read(spark, path).dtypes == df.dtypes
    rowtext.write(df, path, mode="append")
    assert rowtext.read(spark, path).count() == 8
    rowtext.write(df.select("id"), path, single=True)
    assert rowtext.read(spark, path).count() == 4


def test_rowtext_refuses_what_it_cannot_hold(spark, tmp_path):
    for value in (None, "", "a\tb", "a\nb", "a\rb", "# schema: s:VARCHAR", "# schema: x"):
        with pytest.raises(PySparkException):
            rowtext.write(tables.values(spark, [(value,)], "s string"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        rowtext.write(spark.range(1).select(F.array("id")), str(tmp_path / "x"))


def test_rowtext_checks(spark, tmp_path):
    bad = tmp_path / "bad.rv"
    bad.write_text("# schema: a:BIGINT,b:VARCHAR\n1\tx\ty\n")
    with pytest.raises(PySparkException):
        rowtext.read(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        rowtext.read(spark, str(bad), rowtext.parse_header("# schema: a:VARCHAR,b:VARCHAR"))
    renamed = rowtext.read(spark, str(bad), rowtext.parse_header("# schema: c:BIGINT,d:VARCHAR"))
    assert renamed.columns == ["c", "d"]
    empty = tmp_path / "empty.rv"
    empty.write_text("# schema: a:BIGINT\n")
    assert rowtext.read(spark, str(empty)).collect() == []
    none = tmp_path / "none.rv"
    none.write_text("1\t2\n")
    with pytest.raises(ValueError):
        rowtext.read(spark, str(none))


def test_rowtext_headers_are_held_against_the_first(spark, tmp_path):
    for name, text in (("a", "# schema: a:BIGINT,b:VARCHAR\n1\tx\n"), ("b", "# schema: c:BIGINT,d:VARCHAR\n2\ty\n"), ("c", "# schema: a:VARCHAR,b:VARCHAR\n3\tz\n")):
        (tmp_path / name).write_text(text)
    path = lambda *names: [str(tmp_path / n) for n in names]
    assert bag(rowtext.read(spark, path("a", "b"))) == [(1, "x"), (2, "y")]
    with pytest.raises(PySparkException):
        rowtext.read(spark, path("a", "c")).collect()
    (tmp_path / "d").write_text("# schema: a:VARCHAR\nx\n# schema: not one\n")
    with pytest.raises(PySparkException):
        rowtext.read(spark, path("d")).collect()


def test_csv_types_line_is_the_second_line_only(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text('"a, b",c\nVARCHAR,VARCHAR\nx,1\nVARCHAR,VARCHAR\nVARCHAR,VARCHAR\n')
    two.write_text('"a, b",c\nVARCHAR,VARCHAR\ny,2\n')
    df = typed_csv.read(spark, [str(one), str(two)])
    assert df.columns == ["a, b", "c"]
    assert bag(df) == [("VARCHAR", "VARCHAR"), ("VARCHAR", "VARCHAR"), ("x", "1"), ("y", "2")]
    two.write_text("other,c\nVARCHAR,VARCHAR\ny,2\n")
    with pytest.raises(Exception, match="header does not conform"):
        typed_csv.read(spark, [str(one), str(two)]).collect()


def test_csv(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text('my_col,name,score\nBIGINT,VARCHAR,INTEGER\n3,alice,10\n\n1," bob, ""b"" ",7\n2,charlie,9\n')
    df = typed_csv.read(spark, str(path))
    assert df.dtypes == [("my_col", "bigint"), ("name", "string"), ("score", "int")]
    assert bag(df) == [(1, 'bob, "b"', 7), (2, "charlie", 9), (3, "alice", 10)]


def test_csv_without_types_keeps_each_row_once(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("a,b\nx,1\ny,2\n")
    assert bag(typed_csv.read(spark, str(path))) == [("x", "1"), ("y", "2")]
    path.write_text("a,b\nx,1,9\n")
    with pytest.raises(Exception, match="MALFORMED"):
        typed_csv.read(spark, str(path)).collect()


def sample():
    ids = list(range(1, 11))
    return pa.table({"id": pa.array(ids, pa.int64()), "label": LABELS, "price": pa.array([3 * i for i in ids], pa.int32())})


class Memory:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def test_paged_by_hand():
    """A file laid out byte by byte, independent of the writer."""
    page = struct.pack("<q", 7)
    body = b"FVX3" + struct.pack("<I", 14) + struct.pack("<BBIII", 0, 0, 1, 8, 8) + page
    length = len(body) - 4
    described = struct.pack("<IIQQII", 0, 1, 4, length, 8, 8) + struct.pack("<qq", 7, 7)
    footer = struct.pack("<II", 3, 1) + struct.pack("<I", 1) + b"x" + bytes([4]) + struct.pack("<II", 1, 1)
    footer += struct.pack("<QQ", 4, length) + struct.pack("<qq", 7, 7) + struct.pack("<I", 1) + described
    data = body + footer + struct.pack("<I", len(footer)) + b"FVX3"
    assert paged_format.PagedFile(Memory(data)).read_group(0).to_pydict() == {"x": [7]}
    assert paged_format.encode(pa.table({"x": pa.array([7], pa.int64())})) == data


def test_paged_skips_pages():
    file = paged_format.PagedFile(Memory(paged_format.encode(sample(), 4, 2)))
    filters = [("price", "GT", 12), ("label", "NE", "skip")]
    found = [file.read_group(n, ["id", "price", "label"], filters) for n in range(len(file.groups))]
    assert pa.concat_tables(found)["id"].to_pylist() == [6, 7, 8, 9, 10]
    assert pa.concat_tables(found).column_names == ["id", "price", "label"]
    everything = paged_format.PagedFile(Memory(paged_format.encode(sample(), 4, 2)))
    [everything.read_group(n) for n in range(3)]
    assert file.decoded < everything.decoded + 6
    none = paged_format.PagedFile(Memory(paged_format.encode(sample(), 4, 2)))
    assert none.read_group(0, ["id"], [("price", "GT", 100)]).num_rows == 0 and none.decoded == 0
    assert none.read_group(0, ["id"], [("price", "EQ", "3")]).num_rows == 0
    assert none.read_group(0, ["id"], [("price", "EQ", None)]).num_rows == 0
    with pytest.raises(ValueError):
        none.read_group(0, ["nothing"])


@pytest.mark.parametrize("op,keep", [("EQ", lambda a, b: a == b), ("NE", lambda a, b: a != b), ("LT", lambda a, b: a < b), ("LE", lambda a, b: a <= b), ("GT", lambda a, b: a > b), ("GE", lambda a, b: a >= b)])
def test_paged_comparisons(op, keep):
    data = paged_format.encode(sample(), 3, 2)
    for column, constants in (("price", [0, 3, 14, 15, 30, 31]), ("label", ["", "alpha", "omega", "zz"])):
        for c in constants:
            file = paged_format.PagedFile(Memory(data))
            got = [x for n in range(len(file.groups)) for x in file.read_group(n, [column], [(column, op, c)])[column].to_pylist()]
            assert got == [x for x in sample()[column].to_pylist() if keep(x, c)]


def test_paged_refuses_nulls_and_broken_files():
    with pytest.raises(ValueError):
        paged_format.encode(pa.table({"a": pa.array([1, None], pa.int64())}))
    with pytest.raises(ValueError):
        paged_format.encode(pa.table({"a": [1.5]}))
    whole = paged_format.encode(sample())
    for data in (b"", b"FVX3FVX3", whole[:-1], b"XXXX" + whole[4:]):
        with pytest.raises(ValueError):
            paged_format.PagedFile(Memory(data))


def test_paged_source(spark, tmp_path):
    path = str(tmp_path / "paged")
    df = spark.createDataFrame(sample().to_pandas()).selectExpr("id", "label", "CAST(price AS INT) AS price")
    assert paged.write(df.repartition(2), path, 4, 2) == 2
    found = paged.read(spark, path, ["id", "price", "label"]).where("price > 12 AND label != 'skip'")
    assert bag(found.select("id")) == sorted([(i,) for i in range(6, 11)], key=repr)
    assert registry.read(spark, "paged", path).columns == ["id", "label", "price"]
    with pytest.raises(ValueError):
        registry.read(spark, "orc", path)


@pytest.mark.parametrize("enabled", [None, "false", "true"])
def test_paged_needs_no_pushdown_by_spark(spark, small, agree, tmp_path, enabled):
    """A session that isn't get_session()'s has Spark's default, off."""
    before = spark.conf.get(paged.PUSHDOWN)
    try:
        spark.conf.unset(paged.PUSHDOWN) if enabled is None else spark.conf.set(paged.PUSHDOWN, enabled)
        agree(catalog.QUERIES["paged_scan_filter"], catalog.ORACLES["paged_scan_filter"])
        path = str(tmp_path / "paged")
        paged.write(spark.range(100), path, 10, 5)
        assert bag(paged.read(spark, path).where("id >= 97 AND id != 98")) == [(97,), (99,)]
    finally:
        spark.conf.set(paged.PUSHDOWN, before)


def test_paged_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "paged")
    paged.write(spark.range(10), path, 4, 2)

    def fails(batches):
        for batch in batches:
            yield batch
            if 25 in batch.column("id").to_pylist():
                raise RuntimeError("broken")

    with pytest.raises(PySparkException):
        paged.write(spark.range(0, 40, 1, 4).mapInArrow(fails, "id bigint"), path, 4, 2, file_rows=5)
    assert bag(paged.read(spark, path)) == sorted([(i,) for i in range(10)], key=repr)
    assert paged.write(spark.range(0, 6, 1, 2), path) == 2 and paged.read(spark, path).count() == 6
    assert len(list((tmp_path / "paged").glob("*.paged"))) == 2


def test_paged_tasks_are_byte_ranges(spark, tmp_path):
    path = str(tmp_path / "paged")
    paged.write(spark.range(0, 3000, 1, 3), path, 100, 50)
    assert paged.read(spark, path).rdd.getNumPartitions() == 1
    small = paged.read(spark, path, task_bytes=2000)
    assert small.rdd.getNumPartitions() > 6 and bag(small) == sorted([(i,) for i in range(3000)], key=repr)
    assert bag(paged.read(spark, path, filters=[("id", "GE", 2990), ("id", "NE", 2995)])) == [(i,) for i in range(2990, 3000) if i != 2995]


def test_dbgen_text_and_fixed_tables(spark, tmp_path):
    path = tmp_path / "lineitem.tbl"
    path.write_text("1|2|3|4|17|100.00|0.05|0.10|N|O|1996-03-13|1996-02-12|1996-03-22|IN PERSON|TRUCK|x|\n")
    row = tables.lineitem_text(spark, str(path)).first()
    assert (row.l_shipdate, row.l_revenue, row.l_disc_price) == (19960313, 5.0, 95.0)
    assert tables.nation(spark).count() == 25 and tables.region(spark, ["r_name"]).columns == ["r_name"]
    with pytest.raises(PySparkException):
        tables.nation(spark, ["nothing"])


def test_arriving_splits(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    spark.range(10).selectExpr("id % 2 AS k", "id AS v").write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    running = splits.aggregate_arriving(splits.read_arriving(spark, folder, schema), ["k"], ["sum(v) AS s"])
    splits.drain(running, str(tmp_path / "state"), lambda batch, n: out.append(bag(batch)))
    assert out[-1] == [(0, 20), (1, 25)]
    spark.range(2).selectExpr("id AS k", "100 + id AS v").write.mode("append").parquet(folder)
    splits.drain(running, str(tmp_path / "state"), lambda batch, n: out.append(bag(batch)))
    assert out[-1] == [(0, 120), (1, 126)]


def test_shared_folder_is_the_cluster_s_or_a_local_one(spark):
    named = scratch.shared_dir(spark)
    assert named.startswith("file:///") and scratch.scratch_path(spark, "x").startswith(f"{named}/x-")

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = spark.sparkContext  # noqa: N815

    assert scratch.shared_dir(Unset).endswith("/tidewater-shared")
    assert scratch.qualified(spark, "/tmp/a") == "file:///tmp/a" and scratch.qualified(spark, "file:///tmp/b") == "file:///tmp/b"
