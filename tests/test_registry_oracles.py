"""Every registry query gives what its DuckDB SQL gives, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime") or frame[c].map(lambda v: hasattr(v, "isoformat")).any():
            frame[c] = frame[c].astype(str).str.replace("+00:00", "").str.replace(" 00:00:00", "")
        elif frame[c].dtype == "float64":
            frame[c] = frame[c].round(5)
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    mine = q.queries()[name](spark, SF).toPandas()
    told = con.execute(q.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(told.columns)
    assert rows(mine) == rows(told)
