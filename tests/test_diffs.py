"""Diffs of trees that are dealt by commit: the rows of the SQL on odd tables, and no shuffle beyond those of the deals."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolake.operators import trees
from chronolake.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def _deals(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Paths that meet moved and copied ones, paths and blobs that occur again in a commit, commits without a parent or orders, nulls."""
    at, r = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    kinds = [["x", "copy/x", "moved/x", "moved/moved/x", "copy"], ["x", None]]
    parts = [(i, r.choice(["a", "b"]), "Brand#1", r.choice(kinds[i % 2]), r.choice([4, 8, 12, 16, 50, 1])) for i in range(40)]
    rows = [(r.choice([None, *range(30)]), p, r.choice([None, 1, 2, 7]) if p % 2 else r.choice([1, 2, 7])) for p in r.choices(range(42), k=900)]
    tables = {
        "part": spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": spark.createDataFrame([(k,) for k in [None, *range(25)]], "o_orderkey long"),
        "lineitem": spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").selectExpr(
            "*", "1.0D as l_quantity", "0.1D as l_tax", "'A' as l_returnflag", "'F' as l_linestatus", "timestamp'1996-01-01' as l_shipdate"
        ),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS FROM read_parquet('{at}/{name}.parquet/*.parquet')")
    return at, con


def _equals_sql(spark, odd, name):
    at, con = odd
    df = QUERIES[name](spark, at)
    got, want = df.collect(), con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(repr(tuple(x)) for x in got) == sorted(map(repr, want)) and want
    return got


def test_totals_of_a_diff_shuffle_lines_once(spark):
    assert len(_deals(QUERIES["diff_totals"](spark, DATA))) == 1


def test_totals_of_odd_diffs(spark, odd):
    rows = _equals_sql(spark, odd, "diff_totals")
    assert all(any(r[c] for r in rows) for c in ("added", "deleted", "modified", "renamed", "copied"))


def test_totals_by_blob_equal_those_of_renames_and_copies(spark):
    r = random.Random(8)
    side = lambda: [(k, f"p{p}", f"b{r.randrange(4)}", r.choice(["100644", "100755", "120000"])) for k in range(60) for p in r.sample(range(9), r.randrange(7))]
    old, new = (spark.createDataFrame(side(), "k long, path string, blob string, mode string") for _ in range(2))
    diff = trees.tree_diff(old, new, ["k"])
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    rows = trees.compared(both, ["k"])
    assert set(map(tuple, rows.where("status is not null").collect())) == set(map(tuple, diff.collect()))
    want = trees.totals(diff, trees.exact_renames(diff, ["k"]), trees.exact_copies(diff, old, ["k"]), ["k"])
    assert set(map(tuple, trees.blob_totals(rows, ["k"]).collect())) == set(map(tuple, want.collect()))


def test_roots_are_made_once_and_dealt_to_children(spark):
    df = QUERIES["top_level_diff"](spark, DATA)
    assert _deals(df) and all("REPARTITION_BY_NUM" in line for line in _deals(df))
    seen = df._jdf.queryExecution()
    seen.toRdd().count()
    plan = seen.executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 or plan.count("Exchange hashpartitioning") == 3


def test_roots_of_odd_trees(spark, odd):
    rows = _equals_sql(spark, odd, "top_level_diff")
    assert {r.status for r in rows} == {"A", "D", "M"}


def test_rows_come_beside_each_child(spark):
    roots = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, path string")
    links = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None)], "child long, k long")
    assert sorted(map(tuple, trees.beside_children(roots, links).collect())) == [(10, "a"), (10, "b"), (11, "a"), (11, "b")]


def test_an_added_path_that_comes_twice_has_its_mark_in_both_rows(spark):
    rows = [(1, "a", "A", None, "x"), (1, "a", "A", None, None), (1, "b", None, "x", "x"), (1, "c", "D", "y", None), (1, "d", "A", None, "y"), (1, "d", "A", None, "z")]
    got = trees.blob_totals(spark.createDataFrame(rows, "k long, path string, status string, old_blob string, new_blob string"), ["k"])
    assert list(map(tuple, got.collect())) == [(1, 0, 0, 0, 2, 2)]
