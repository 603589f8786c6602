"""Every query over the smallest tables against its SQL twin."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from quillgraph.plans.catalog import QUERIES
from quillgraph.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    columns = sorted(frame.columns)
    return Counter(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, twin, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        want = twin.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["doc_id", "phrase", "norm_rank"]
