import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        c.execute(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    return c


def same_rows(df, relation, digits=6):
    """Whether a Spark result has the rows of a DuckDB result."""
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)

    def plain(v):
        if isinstance(v, float):
            return round(v, digits)
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    own = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    other = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in relation.fetchall()), key=str)
    assert own == other
