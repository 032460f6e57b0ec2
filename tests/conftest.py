import glob
import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import get_session

    session = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tempfile.mkdtemp()}", "spark.sql.warehouse.dir": tempfile.mkdtemp()},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.fixture
def agree(spark, duck):
    """Compares a query with its SQL, as bags of rows with columns by name."""

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        ours = sorted(repr([r[n] for n in names]) for r in df.collect())
        relation = duck.sql(sql)
        columns = list(relation.columns)
        assert sorted(columns) == names
        theirs = sorted(repr([r[columns.index(n)] for n in names]) for r in relation.fetchall())
        assert ours == theirs

    return check
