import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cairn.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Makes a DataFrame of tuples: rows(schema, *tuples)."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


def as_set(df, *cols):
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    assert len(out) == len(set(out)), "a row came twice"
    return set(out)
