"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from paperloom.plans import registry
from paperloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Trained for long; test_models.py tests what they are made of.
SLOW = {"compare_models", "ablation", "select_config", "grid_c_gamma", "grid_vocab", "train_rbf_svm_approx", "train_rf", "train_logreg", "train_linear_svm", "train_nb"}


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) > 1 and df.count() > 0
