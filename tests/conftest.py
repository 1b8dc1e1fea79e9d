import glob
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", own)
        .config("spark.checkpoint.dir", f"{own}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{own}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(df):
    """The rows as a sorted list of texts by sorted column names, doubles to nine digits."""
    names = sorted(df.columns)
    show = lambda v: "" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    frame = df if hasattr(df, "itertuples") else df.toPandas()
    return names, sorted(tuple(show(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None))
