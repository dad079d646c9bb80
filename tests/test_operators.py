"""Small graphs and arrays with known results."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import graph as G
from tessera.operators import partition as P
from tessera.sources import graph as S
from tessera.streaming import messages as M


def both(pairs):
    return sorted({p for a, b in pairs for p in ((a, b), (b, a))})


K4, K5 = (list(itertools.combinations(range(n), 2)) for n in (4, 5))
BOW = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)]
PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
STAR = [(0, i) for i in range(1, 6)]


@pytest.mark.parametrize("pairs, n, triangles, core", [(K4, 4, 4, [3] * 4), (K5, 5, 10, [4] * 5), (BOW, 5, 2, [2] * 5), (PETERSEN, 10, 0, [3] * 10), (STAR, 7, 0, [1] * 6 + [0])])
def test_triangles_and_cores(spark, pairs, n, triangles, core):
    g = S.from_edges(spark, both(pairs), n)
    assert G.triangle_count(g.edges).first()[0] == triangles
    assert G.triangle_rows(G.orient(g.edges)).count() == triangles
    assert [G.triangle_types(g.edges, k).first()["total"] for k in (1, 2, 5)] == [triangles] * 3
    assert G.orient(g.edges).count() == len(pairs)
    assert [r["coreness"] for r in G.coreness(g.vertices, g.edges).orderBy("id").collect()] == core


def test_triangles_of_a_hub_graph(spark):
    hub = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(1, 2999)]
    assert G.triangle_count(S.from_edges(spark, both(hub)).edges).first()[0] == 2998


def test_set_operations(spark):
    edges = spark.createDataFrame([(9, w) for w in (1, 2, 3, 5)] + [(5, w) for w in (2, 3, 4)], "src long, dst long")
    vertices = spark.range(10).select("id", F.lit(0).alias("label"))
    pairs = spark.createDataFrame([(9, 5), (5, 7)], "v long, u long")
    of = lambda f: sorted(r["w"] for r in f(pairs, edges, vertices, 0).where("v = 9").collect())
    assert (of(G.intersect_set), of(G.difference_set), of(G.difference_edge_induced)) == ([2, 3], [1], [1, 2, 3])
    assert {(r["v"], r["cnt"]) for r in G.set_sizes(pairs, G.intersect_set(pairs, edges, vertices)).collect()} == {(9, 2), (5, 0)}
    labelled = spark.createDataFrame([(i, 1) for i in range(3)] + [(i, 2) for i in range(3, 5)], "id long, label int")
    assert G.frequent_labels(labelled, 3).first()[0] == 0 and G.frequent_vertices(labelled, 3).count() == 3
    assert [r["cnt"] for r in G.label_frequency(labelled, 3).orderBy("label").collect()] == [0, 3, 2, 0]


def test_arrays(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(4)], "i long, v long")
    assert [r["s"] for r in A.scan(rows, "i", "v").orderBy("i").collect()] == [1, 3, 6, 10]
    assert [r["s"] for r in A.scan(rows, "i", "v", exclusive=True).orderBy("i").collect()] == [0, 1, 3, 6]
    assert [r["s"] for r in A.scan(rows, "i", "v", exclusive=True, total=True).orderBy("i").collect()] == [0, 1, 3, 6, 10]
    assert A.scan(rows.where("false"), "i", "v", exclusive=True, total=True).collect() == [(0, 0)]
    line = spark.createDataFrame([(i, i + 1) for i in range(5)], "i long, v long")
    assert [r["p"] for r in A.convolve(line, {(-1,): 1, (0,): 0, (1,): -1}, ["i"]).orderBy("i").collect()] == [-2, -2, -2, -2, 4]
    rng = np.random.default_rng(0)
    x, y = rng.integers(-9, 9, (7, 5)), rng.integers(-9, 9, (5, 11))
    a = spark.createDataFrame([(int(i), int(k), int(v)) for (i, k), v in np.ndenumerate(x)], "row long, k long, v long")
    b = spark.createDataFrame([(int(k), int(j), int(v)) for (k, j), v in np.ndenumerate(y)], "k long, col long, v long")
    for got in (A.matmul(a, b), A.matmul_blocked(a, b, 4)):
        assert {(r["row"], r["col"]): r["v"] for r in got.collect()} == {k: int(v) for k, v in np.ndenumerate(x @ y)}
    texts = spark.createDataFrame([("abca",), (None,), ("",), ("é~",)], "text string")
    assert {r["bin"]: r["cnt"] for r in A.histogram(texts, "text").where("cnt > 0").collect()} == {97: 2, 98: 1, 99: 1, 126: 1}
    spelt = spark.createDataFrame([("0x1F",), ("017",), ("42",), ("-0x10",), ("zz",)], "s string")
    assert [r[0] for r in spelt.select(A.parse_int(F.col("s"))).collect()] == [31, 15, 42, -16, None]


def test_convolution_tiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(-9, 9, (3, 23, 31))
    there = rng.random((23, 31)) < 0.9
    cells = [(c, y, x, int(image[c, y, x])) for c in range(3) for y in range(23) for x in range(31) if there[y, x]]
    df = spark.createDataFrame(cells, "ch long, y long, x long, v long")
    mask = {(c, i, j): int(rng.integers(-3, 4)) for c in range(3) for i in range(-2, 3) for j in range(-1, 2)}
    padded = np.zeros((3, 27, 33), int)
    padded[:, 2:25, 1:32] = np.where(there, image, 0)
    want = sum(w * padded[c, 2 + i : 25 + i, 1 + j : 32 + j] for (c, i, j), w in mask.items())
    for strip in (8, 512):
        got = {(r["y"], r["x"]): r["p"] for r in A.convolve(df, mask, ["y", "x"], "ch", strip).collect()}
        assert got == {(y, x): int(want[y, x]) for y in range(23) for x in range(31) if there[y, x]}
    assert A.convolve(df.where("false"), mask, ["y", "x"], "ch").count() == 0


def test_mailboxes(spark):
    assert M.mailbox_checksum(spark, 4, 7, 8).first()[0] == 4_821_208
    got = {r["pe"]: (r["sent"], r["received"]) for r in M.mailbox_totals(spark, 4).collect()}
    assert got == {0: (1140, 1068), 1: (1104, 1176), 2: (1148, 1044), 3: (1096, 1200)}
    hops = M.ring_copy(spark.range(2).withColumnRenamed("id", "x"), 3).collect()
    assert sorted(tuple(r) for r in hops) == sorted((h, h if h < 3 else -1, x) for h in range(4) for x in range(2))


def test_vertex_sets(spark):
    edges = spark.createDataFrame([(5, w) for w in (2, 3, 4)] + [(9, 1)], "src long, dst long")
    vertices = spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("label"))
    pairs = spark.createDataFrame([(9, 5), (7, 8)], "v long, u long")
    members = spark.createDataFrame([(9, 5, w) for w in (1, 2, 3, 5)] + [(7, 8, 2)], "v long, u long, w long")
    of = lambda f, label, v: sorted(r["w"] for r in f(pairs, edges, vertices, label, members).where(F.col("v") == v).collect())
    assert [of(f, None, 9) for f in (G.intersect_set, G.difference_set, G.difference_edge_induced)] == [[2, 3], [1], [1, 2, 3]]
    assert [of(f, None, 7) for f in (G.intersect_set, G.difference_set, G.difference_edge_induced)] == [[], [2], [2]]
    assert [of(f, 2, 9) for f in (G.intersect_set, G.difference_set, G.difference_edge_induced)] == [[2], [], [2]]
    G_max, G.MAX_LIST = G.MAX_LIST, 2  # lists in several parts
    try:
        assert [of(f, None, 9) for f in (G.intersect_set, G.difference_set)] == [[2, 3], [1]]
        assert sorted(r["w"] for r in G.intersect_set(spark.createDataFrame([(5, 5)], "v long, u long"), edges, vertices).collect()) == [2, 3, 4]
    finally:
        G.MAX_LIST = G_max


def test_bounds_fields_and_edge_list(spark):
    ids = spark.createDataFrame([(-1,), (0,), (4,), (5,), (None,)], "q long")
    assert [r["valid"] for r in G.valid(ids, "q", 5).collect()] == [False, True, True, False, False]
    loops = S.from_edges(spark, [(0, 0), (0, 1), (1, 0), (1, 1)])
    assert sorted((r[0], r[1]) for r in G.edge_list(loops.edges).collect()) == [(0, 1), (1, 0)]
    assert [tuple(r) for r in G.edge_list(loops.edges, True, False).collect()] == [(1, 0)]
    assert [tuple(r) for r in G.numbered_edges(loops.edges).orderBy("e").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    assert loops.fields() == {"has_label": True, "has_vlabel": True, "has_elabel": False}


def test_triple_index_is_the_inverse(spark):
    for k in (3, 7):
        rows = P.triples(spark, k).withColumn("again", P.triple_index("a", "b", "c", k)).collect()
        assert len(rows) == k * (k - 1) * (k - 2) // 6 and all(r["idx"] == r["again"] for r in rows)


def test_halo_subgraphs(spark):
    edges = both(PETERSEN)
    df, n, k = S.from_edges(spark, edges).edges, 10, 3
    local = P.halo_vertices(df, n, k)
    got = {}
    for r in P.halo_edges(df, local).collect():
        got.setdefault(r["part"], set()).add((r["src"], r["dst"], r["lsrc"], r["ldst"]))
    ranges = {r["part"]: (r["local_begin"], r["local_end"]) for r in P.halo_ranges(local).collect()}
    for part in range(k):
        own = set(range(part * 4, min(n, part * 4 + 4)))
        ids = sorted(own | {b for a, b in edges if a in own})
        place = {v: i for i, v in enumerate(ids)}
        assert got[part] == {(a, b, place[a], place[b]) for a, b in edges if a in place and b in place}
        assert ids[slice(*ranges[part])] == sorted(own)


def test_balanced_partition(spark):
    rng = np.random.default_rng(7)
    groups = [list(range(i * 20, i * 20 + 20)) for i in range(4)]
    pairs = {tuple(sorted(rng.choice(g, 2, replace=False).tolist())) for g in groups for _ in range(120)} | {(0, 79), (20, 41)}
    g = S.from_edges(spark, both(pairs), 80)
    start = g.vertices.select("id", F.pmod("id", F.lit(4)).alias("cluster"))
    parts = P.balanced_partition(g.vertices, g.edges, 4, rounds=6)
    assert sorted(r["count"] for r in parts.groupBy("cluster").count().collect()) == [20] * 4
    before, after = (P.stats(g.edges, c).first()["cut"] for c in (start, parts))
    assert after < before


def test_raw_partitions_round_trip(spark, tmp_path):
    edges = both(BOW)
    g = S.from_edges(spark, edges)
    parts = g.vertices.select("id", F.pmod("id", F.lit(2)).alias("part"))
    prefix = f"file://{tmp_path}/w"
    S.write_raw_partitions(g.edges, parts, 5, prefix)
    seen = []
    for rank in range(2):
        got, own, owner = S.read_partition(spark, prefix, rank)
        rows = sorted((r["src"], r["dst"]) for r in got.collect())
        assert rows == [e for e in edges if e[0] % 2 == rank]
        seen += rows
        assert [r["id"] for r in own.orderBy("n").collect()] == list(range(rank, 5, 2))
        assert [r["part"] for r in owner.orderBy("id").collect()] == [0, 1, 0, 1, 0]
        meta = S.read_meta(spark, prefix, partition=rank).first()
        assert (meta["nv"], meta["ne"], meta["max_subg_nv"]) == (5, len(rows), 3)
        assert (tmp_path / f"w{rank}.edge.txt").read_text().split() == [str(b) for _, b in rows]
        assert (tmp_path / f"w{rank}.csr.txt").read_text().splitlines()[0].startswith(f"{rank}: ")
    assert sorted(seen) == edges


def test_bipartite_meta(spark, tmp_path):
    (tmp_path / "b.meta.txt").write_text("3 4 9 4 8 1 1 2 0 2 1\n")
    meta = S.read_meta(spark, f"file://{tmp_path}/b", bipartite=True).first()
    assert (meta["nv_left"], meta["nv_right"], meta["ne"], meta["max_degree"]) == (3, 4, 9, 2)


def test_text_source_and_random_vector(spark, tmp_path):
    (tmp_path / "own.txt").write_text("abc\nca\n")
    assert {r["bin"]: r["cnt"] for r in A.histogram(S.read_text(spark, f"file://{tmp_path}/own.txt"), "value").where("cnt > 0").collect()} == {97: 2, 98: 1, 99: 2}
    made = S.read_text(spark, f"file://{tmp_path}/made", 3500, seed=1)
    texts = [r["value"] for r in made.collect()]
    assert len(texts) == 4 and sum(len(t) + 1 for t in texts) == 3500 and all(ord(c) < 128 for t in texts for c in t)
    assert sorted(r["value"] for r in S.read_text(spark, f"file://{tmp_path}/made").collect()) == sorted(texts)
    x = S.random_vector(spark, 1000, -10, 10, seed=3)
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert -10 <= lo < -9 and 9 < hi < 10 and n == 1000


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    edges = both(K5)
    (tmp_path / "g.vertex.bin").write_bytes(np.searchsorted([a for a, _ in edges], np.arange(6)).astype("<i8").tobytes())
    (tmp_path / "g.edge.bin").write_bytes(np.array([b for _, b in edges], "<i4").tobytes())
    (tmp_path / "g.meta.txt").write_text("5 20 4 8 1 2 4 0 0 0\n")
    assert main([]) == 1 and main([f"file://{tmp_path}/g"]) == 0
    out = capsys.readouterr().out
    assert "total_num_triangles 10" in out and "ne 20" in out


def test_messages(spark):
    assert [r["received"] for r in M.ring_shift(spark, 4).orderBy("pe").collect()] == [3, 0, 1, 2]
    assert [r["target"] for r in M.ring_reduce(spark, 4).orderBy("pe").collect()] == [6, 5, 4, 3]
    assert {r["src"]: r["total"] for r in M.all_to_all(spark, 4).collect()} == {0: 6, 1: 10, 2: 14, 3: 18}
    assert {r["total"] for r in M.queue_sum(spark, 4, 2, 3).collect()} == {18}
    assert {r["total"] for r in M.queue_sum(spark, 4, 2, 1000).collect()} == {2_997_000}


def test_raw_csr_round_trip(spark, tmp_path):
    edges = both(BOW)
    ptr = np.searchsorted([a for a, _ in edges], np.arange(6)).astype("<i8")
    (tmp_path / "g.vertex.bin").write_bytes(ptr.tobytes())
    (tmp_path / "g.edge.bin").write_bytes(np.array([b for _, b in edges], "<i4").tobytes())
    (tmp_path / "g.meta.txt").write_text("5 12\n4 8 1 2\n4\n0\n0\n0\n")
    (tmp_path / "g.vlabel.bin").write_bytes(bytes([1, 2, 1, 2, 1]))
    prefix = f"file://{tmp_path}/g"
    assert sorted((r["src"], r["dst"]) for r in S.read_csr(spark, prefix).collect()) == edges
    meta = S.read_meta(spark, prefix).first()
    assert (meta["nv"], meta["ne"], meta["max_degree"]) == (5, 12, 4)
    vertices = spark.range(5)
    assert [r["label"] for r in S.read_labels(spark, f"{prefix}.vlabel.bin", vertices, 2).orderBy("id").collect()] == [1, 2, 1, 2, 1]
    assert S.read_labels(spark, f"{prefix}.none", vertices, 3).where("label between 1 and 3").count() == 5
    with pytest.raises(ValueError):
        S.read_labels(spark, f"{prefix}.vlabel.bin", vertices, 3)


def test_raw_partition_and_edge_labels(spark, tmp_path):
    edges = [(0, 1), (0, 2), (2, 1)]
    (tmp_path / "p1.vertex.bin").write_bytes(np.array([0, 2, 2, 3], "<i8").tobytes())
    (tmp_path / "p1.edge.bin").write_bytes(np.array([1, 2, 1], "<i4").tobytes())
    (tmp_path / "p1.meta.txt").write_text("3 2 3\n2 3 2\n")
    (tmp_path / "p1.vertex_list.bin").write_bytes(np.array([0, 2], "<i8").tobytes())
    (tmp_path / "p1.part.bin").write_bytes(np.array([1, 0, 1], "<i8").tobytes())
    (tmp_path / "p1.elabel.bin").write_bytes(bytes([5, 6, 5]))
    prefix = f"file://{tmp_path}/p"
    got, own, parts = S.read_partition(spark, prefix, 1)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == edges
    assert [r["id"] for r in own.orderBy("n").collect()] == [0, 2] and [r["part"] for r in parts.orderBy("id").collect()] == [1, 0, 1]
    assert S.read_meta(spark, prefix, partition=1).first().asDict() == {"nv": 3, "n_real": 2, "ne": 3, "max_subg_nv": 2, "max_subg_ne": 3, "max_degree": 2}
    assert sorted(tuple(r) for r in S.read_edge_labels(spark, f"{prefix}1.elabel.bin", got, 2).collect()) == [(0, 1, 5), (0, 2, 6), (2, 1, 5)]
    assert {r["label"] for r in S.read_edge_labels(spark, f"{prefix}.none", got, 0).collect()} == {1}
    with pytest.raises(ValueError):
        S.read_edge_labels(spark, f"{prefix}1.elabel.bin", got, 1)


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("g"), "id")
    got = A.ranked(rows, ["g"], ["id"], "r").collect()
    want = {}
    for g in (0, 1):
        want |= {i: r for r, i in enumerate(i for i in range(1000) if (i % 10 == 0) == bool(g))}
    assert {r["id"]: r["r"] for r in got} == want
    assert A.ranked(rows.where("false"), [], ["id"], "r").count() == 0


def test_partition_sinks_prune(spark, tmp_path):
    g = S.from_edges(spark, both(K5))
    clusters = g.vertices.select("id", (F.col("id") % 2).alias("cluster"))
    S.write_partitioned(P.blocks(g.edges, clusters), ["ci", "cj"], f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.count() == 20 and back.where("ci = 0 and cj = 1").count() == 6
    assert "PartitionFilters: [isnotnull(ci" in back.where("ci = 0").select("src")._jdf.queryExecution().toString()


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    vertices = spark.range(3).select("id", F.lit(1).alias("label"))
    assert G.triangle_count(edges).first()[0] == 0
    assert [r["coreness"] for r in G.coreness(vertices, edges).collect()] == [0, 0, 0]
    assert A.scan(edges, "src", "dst").count() == 0
