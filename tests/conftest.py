import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import local_session

    session = local_session(4, 4, "gleanery-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


def same_rows(frame, relation) -> None:
    """A Spark result and a DuckDB relation hold the same rows, column by name."""
    a, b = frame.toPandas(), relation.df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if hasattr(v, "isoformat") else v

    rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[columns].astype(object).itertuples(index=False, name=None))
    assert rows(a) == rows(b)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con
