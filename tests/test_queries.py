"""Every registered query of the library against its SQL on the same tables."""

import duckdb
import pytest

from chronolake.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def same(row):
    return repr([f"{x:.9g}" if isinstance(x, float) else x for x in row])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(duck.sql(ORACLE[name]).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(same, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(same, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
