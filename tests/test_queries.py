"""Every registered query with SQL against DuckDB on the same tables, compared as the driver does: by sorted columns and rows."""

import duckdb
import pytest

import motley.plans.analyses  # noqa: F401
import motley.plans.assembly  # noqa: F401
import motley.plans.kinetics  # noqa: F401
import motley.plans.storage  # noqa: F401
import motley.plans.queries  # noqa: F401
from motley.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object)
    frame = frame.where(frame.notna(), None)
    return names, sorted(map(tuple, frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    names, ours = rows(QUERIES[name](spark, DATA).toPandas())
    others, theirs = rows(duck.sql(SQL[name]).df())
    assert names == others
    assert len(ours) == len(theirs)
    key = lambda r: tuple((x is None, str(type(x).__name__ == "str"), x if x is not None else 0) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_entry_imports_without_the_pipeline_package(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
