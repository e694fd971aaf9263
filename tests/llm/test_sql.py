"""The subpackage's queries with SQL against DuckDB."""

import duckdb
import pytest

from motley.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(ORACLES[name]).df()
    ours = QUERIES[name](spark, DATA).toPandas()
    names = sorted(theirs.columns)
    assert sorted(ours.columns) == names
    rows = lambda x: sorted(map(tuple, x[names].astype(object).where(x[names].notna(), None).itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)
