"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from vicinity import queries

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x
    return sorted((tuple(clean(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, ROOT)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"knn_graph_pruned", "nn_descent", "hybrid_search", *(f"graph_search_type{t}" for t in range(4))}
