import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as a Parquet table in a few files and read it."""
    made = []

    def make(rows, schema, files=3):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


def as_rows(rows, columns):
    """Rows as comparable strings, floats rounded."""

    def show(v):
        if isinstance(v, float):
            return f"{v:.9f}"
        return "" if v is None else str(v)

    return sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
