from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from reelsift.session import get_spark

    session = get_spark("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the test tables aren't here")
    return path


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Holds a query's rows against those of its SQL in DuckDB."""
    import duckdb

    def run(query, sql, path):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for p in Path(path).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got, want = query(spark, path).toPandas(), con.execute(sql).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        rows = lambda d: sorted(map(repr, d[names].astype(object).where(d[names].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)
        return len(got)

    return run
