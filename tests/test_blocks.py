"""Triangles on packed blocks against plain Python, what they shuffle, and cores in few jobs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.packing import pack, unpack
from tessera.operators import blocks
from tessera.operators import graph as G
from tessera.sources import graph as S


def both(pairs):
    return sorted({p for a, b in pairs for p in ((a, b), (b, a))})


def shuffled(spark, run):
    """What ``run`` returns, and the bytes it shuffles."""
    sc, empty = spark.sparkContext, spark._jvm.java.util.ArrayList
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(empty(), False, False, sc._gateway.new_array(spark._jvm.double, 0), empty())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return run(), total() - before


@pytest.fixture(scope="module")
def dense(spark):
    """A random graph of 500 vertices and about 50,000 edges; its lists are long."""
    rng = random.Random(1)
    pairs = [p for p in itertools.combinations(range(500), 2) if rng.random() < 0.4]
    return pairs, S.from_edges(spark, both(pairs)).edges.localCheckpoint()


def brute(pairs):
    """Triangles of oriented edges, 0 included."""
    nbrs = {}
    for a, b in both(pairs):
        nbrs.setdefault(a, set()).add(b)
    rank = {v: (len(n), v) for v, n in nbrs.items()}
    out = {v: {w for w in n if rank[w] > rank[v]} for v, n in nbrs.items()}
    return {(u, v): [w for w in out[u] & out[v]] for u in out for v in out[u]}


def test_packed_columns():
    for v in ([], [5], [-3, 2**62, -(2**62)], range(999)):
        assert unpack(pack(np.array(v, np.int64))).tolist() == list(v)


def test_types_shuffle_little(spark, dense):
    pairs, edges = dense
    row, size = shuffled(spark, lambda: G.triangle_types(edges, 4).first())
    found = [(u % 4, v % 4, w % 4) for (u, v), ws in brute(pairs).items() for w in ws]
    three = sum(len(set(x)) == 3 for x in found)
    assert tuple(row) == (len(found) - three, three, len(found))
    assert size < 100 * len(pairs)


def test_graph_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(-30, 30)) for _ in range(900)] + [(7, i) for i in range(300)] * 2 + [(99, 1)]
    groups = {}
    for o, p in rows:
        groups.setdefault(o, set()).add(p)
    want = {(a, b) for g in groups.values() for a in g for b in g if a != b}
    lines = spark.createDataFrame(rows, "o long, p long")
    got = [tuple(r) for r in S.joined_in_groups(lines).collect()]
    assert len(got) == len(want) and set(got) == want
    assert S.joined_in_groups(lines.where("false")).collect() == []


def test_counts_of_edges(spark, dense, monkeypatch):
    pairs, edges = dense
    dag, want = G.orient(edges), {e: len(ws) for e, ws in brute(pairs).items()}
    got, size = shuffled(spark, lambda: G.common_out_neighbours(dag).collect())
    assert len(got) == len(want) and {(r["src"], r["dst"]): r["cnt"] for r in got} == want
    assert size < 100 * len(pairs)
    monkeypatch.setattr(blocks, "HELD", 5000)  # several vertex blocks
    assert {(r["src"], r["dst"]): r["cnt"] for r in G.common_out_neighbours(dag).collect()} == want
    hub = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(1, 2999)]
    rows = G.common_out_neighbours(G.orient(S.from_edges(spark, both(hub)).edges))
    assert tuple(rows.agg(F.count("*"), F.sum("cnt")).first()) == (len(hub), 2998)


def test_classes_without_triangles_have_no_row(spark, dense):
    square = S.from_edges(spark, both([(0, 1), (1, 2), (2, 3), (0, 3)])).edges
    assert G.push_pull_triangles(G.orient(square), 4).collect() == []
    pairs, edges = dense
    want, found = {}, brute(pairs)
    out = {}
    for u, _ in found:
        out[u] = out.get(u, 0) + 1
    for (u, v), ws in found.items():
        cls = "local" if u % 4 == v % 4 else "push" if out[u] < out.get(v, 0) else "pull"
        want[cls] = want.get(cls, 0) + len(ws)
    got, size = shuffled(spark, lambda: G.push_pull_triangles(G.orient(edges), 4).collect())
    assert {r["cls"]: r["triangles"] for r in got} == {k: n for k, n in want.items() if n}
    assert size < 100 * len(pairs)


def peel(pairs):
    nbrs = {}
    for a, b in both(pairs):
        nbrs.setdefault(a, set()).add(b)
    degree, core, k = {v: len(n) for v, n in nbrs.items()}, {}, 0
    while degree:
        v = min(degree, key=degree.get)
        k = max(k, degree.pop(v))
        core[v] = k
        for w in nbrs[v] & degree.keys():
            degree[w] -= 1
    return core


SPARSE = [p for p in itertools.combinations(range(60), 2) if random.Random(str(p)).random() < 0.15]


@pytest.mark.parametrize("held", [100, 1 << 20])
def test_cores_in_few_jobs(spark, monkeypatch, held):
    path, sc = [(i, i + 1) for i in range(60)], spark.sparkContext
    monkeypatch.setattr(blocks, "HELD", held)
    for pairs in (SPARSE, path):
        g = S.from_edges(spark, both(pairs))
        sc.setJobGroup(f"cores {held} {len(pairs)}", "")
        assert {r["id"]: r["coreness"] for r in G.coreness(g.vertices, g.edges).collect() if r["coreness"]} == peel(pairs)
        jobs = sc.statusTracker().getJobIdsForGroup(f"cores {held} {len(pairs)}")
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert held == 100 or len(jobs) < 30


def test_cores_by_joins_keep_estimates_small(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_VERTICES", 0)
    g = S.from_edges(spark, both(SPARSE))
    rows = G.coreness(g.vertices, g.edges)
    assert {r["id"]: r["coreness"] for r in rows.collect() if r["coreness"]} == peel(SPARSE)
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 40
