"""Every registered query against its SQL at the smallest scale."""

import os
import re

import duckdb
import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if value is None else str(value) if not isinstance(value, (int, bool)) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    number = re.compile(r"^-?\d+\.0$")
    same = lambda rs: [tuple(x[:-2] if number.match(x) else x for x in r) for r in rs]
    assert sorted(same(rows(df.columns, [tuple(r) for r in got]))) == sorted(same(rows(columns, cursor.fetchall())))
