"""Every registered query with SQL against DuckDB, and the others against plain Python, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans.graph_queries import ORACLE_SQL, QUERIES
from tessera.sources.graph import copurchase

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in order) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want


def peel(nbrs):
    degree = {v: len(n) for v, n in nbrs.items()}
    core, k = {}, 0
    while degree:
        v = min(degree, key=degree.get)
        k = max(k, degree.pop(v))
        core[v] = k
        for w in nbrs[v]:
            if w in degree:
                degree[w] -= 1
    return core


def test_kcore_and_propagation(spark):
    g = copurchase(spark, SF)
    nbrs = {r["id"]: set() for r in g.vertices.collect()}
    for r in g.edges.collect():
        nbrs[r["src"]].add(r["dst"])
    want = peel(nbrs)
    assert {r["id"]: r["coreness"] for r in QUERIES["kcore"](spark, SF).collect()} == want
    assert QUERIES["core_length"](spark, SF).first()[0] == sum(c > 1 for c in want.values())
    sizes = sorted(r["count"] for r in QUERIES["balanced_partition"](spark, SF).groupBy("cluster").count().collect())
    assert sum(sizes) == len(nbrs) and sizes[-1] - sizes[0] <= 1
    cut = lambda name: QUERIES[name](spark, SF).first()["cut"]
    assert cut("balanced_partition_stats") < cut("partition_stats")
