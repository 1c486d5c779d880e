"""Every corpus query with SQL equals it on the small tables."""

import duckdb
import pytest
from tidemark.llm.queries import ORACLE, QUERIES

from ..test_oracle import DIR, canonical


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert canonical(got.select(*columns).collect()) == canonical(sql) and sql
