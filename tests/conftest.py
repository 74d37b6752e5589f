import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def same_rows(frame, sql, sf_dir):
    """Whether a frame has the rows that DuckDB gives for ``sql`` over the tables of ``sf_dir``."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(frame.columns)

    def plain(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v

    def key(r):
        return [(v is None, str(type(v) is bool), str(v)) for v in r]

    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=key)
    assert len(got) == len(want)
    return got == want


@pytest.fixture
def agrees():
    return same_rows
