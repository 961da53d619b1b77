import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from adit.runtime import clear, local_session

    session = local_session(4, "tests")
    yield session
    clear(session)


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def compare(spark):
    """Whether a registered query has the rows of its SQL on a folder of tables."""
    import glob

    import duckdb

    def run(name: str, queries: dict, sql: dict, folder: str = SF):
        db = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
        got = queries[name](spark, folder)
        want = db.sql(sql[name])
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        left = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
        right = sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()), key=repr)
        assert left == right

    return run
