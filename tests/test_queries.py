import datetime

import duckdb
import pandas as pd
import pytest

from tessera.plans import archive_queries, evidence_queries, payload_queries, plan_queries, queries, run_queries, scan_queries, store_queries, stream_queries, value_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return pd.Timestamp(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in got.collect()) == want
    assert want
