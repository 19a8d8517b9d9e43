"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from granary import catalog

DATA = os.environ.get("GRANARY_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, (bool,)) or hasattr(v, "dtype") and v.dtype == bool:
            return bool(v)
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int):
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(cell(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_other_query_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).columns == ["query_id", "rank", "doc_id", "source_id", "adjusted"]
