"""Every query of the library against its DuckDB SQL over the smallest tables; those without SQL run and keep their schema."""

import math
import os

import duckdb
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return v


def rows(data, names):
    at = sorted(range(len(names)), key=lambda k: names[k])
    coarse = lambda r: repr([round(v, 3) if isinstance(v, float) else v for v in r])
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=coarse)


def close(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-5) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert close(rows(got.collect(), got.columns), rows(want.fetchall(), names))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    got = plans.queries()[name](spark, SF)
    assert got.columns and len(got.collect()) > 0


@pytest.mark.parametrize("name,table", [("f24_overlapping_crops", "part"), ("m10_located", "customer")])
def test_all_ids_are_read(spark, duck, name, table):
    """Once these read a part of the ids only; here they are held against their SQL on more of them."""
    more, sql = SF.replace("0.001", "0.01"), plans.oracle_sql()[name]
    for t in (table, "supplier"):
        sql = sql.replace(f"from {t}", f"from '{more}/{t}.parquet'")
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    got = plans.queries()[name](spark, more)
    assert close(rows(got.collect(), got.columns), rows(want.fetchall(), names))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
