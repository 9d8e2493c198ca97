import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.is_dir():
        pytest.skip("the driver's tables aren't here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and SQL give the same columns and rows."""

    def check(df, sql):
        names = sorted(df.columns)
        relation = duck.sql(sql)
        assert sorted(relation.columns) == names
        shown = lambda v: round(v, 9) if isinstance(v, float) else v
        ours = sorted((tuple(shown(r[n]) for n in names) for r in df.collect()), key=str)
        at = [relation.columns.index(n) for n in names]
        theirs = sorted((tuple(shown(r[i]) for i in at) for r in relation.fetchall()), key=str)
        assert ours == theirs

    return check
