"""Every query with SQL equals it on the small tables."""

import duckdb
import pytest
from tidemark.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def canonical(rows):
    out = []
    for row in rows:
        out.append(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    sql = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert canonical(got.select(*columns).collect()) == canonical(sql)
