import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def same_rows():
    """Compare a DataFrame with the rows of a DuckDB query on the same tables."""
    import duckdb

    def check(df, sql, sf_dir=SMALL):
        con = duckdb.connect()
        for file in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
        theirs = con.sql(sql)
        names = sorted(df.columns)
        assert sorted(theirs.columns) == names
        # Rows as they come, not through frames, in which whole numbers beside nulls become fractions.
        ours = sorted(map(repr, map(tuple, df.select(*(f"`{n}`" for n in names)).collect())))
        assert ours == sorted(map(repr, theirs.select(", ".join(f'"{n}"' for n in names)).fetchall()))
        return len(ours)

    return check
