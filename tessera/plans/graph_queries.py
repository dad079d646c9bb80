"""Registered queries over the fixture tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import graph as G
from tessera.operators import partition as P
from tessera.plans.storage import new_path
from tessera.sources.graph import copurchase, read_table, write_partitioned
from tessera.streaming import messages as M

QUERIES: dict = {}
ORACLE_SQL: dict = {}

PARTS, LABEL, THRESHOLD, WIDTH, TILE = 4, 7, 40, 100, 16

#: The materialised graph: parts of one order are joined; degrees; oriented edges; pairs; neighbours of label 7.
GRAPH = """
WITH RECURSIVE li AS MATERIALIZED (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT a.p src, b.p dst FROM li a JOIN li b ON a.o = b.o AND a.p <> b.p),
v AS MATERIALIZED (SELECT p_partkey id, p_size label FROM part),
deg AS MATERIALIZED (SELECT src id, count(*) d FROM e GROUP BY src),
dag AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN deg x ON x.id = e.src JOIN deg y ON y.id = e.dst WHERE y.d > x.d OR (y.d = x.d AND e.dst > e.src)),
od AS MATERIALIZED (SELECT src id, count(*) d FROM dag GROUP BY src),
pr AS MATERIALIZED (SELECT src v, dst u FROM e WHERE src < dst),
nl AS MATERIALIZED (SELECT e.src v, e.dst w FROM e JOIN v ON v.id = e.dst WHERE v.label = 7),
nv AS MATERIALIZED (SELECT max(p_partkey) + 1 n FROM part)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def graph_query(name: str, sql: str):
    """A query of (graph) whose SQL continues the graph's common table expressions."""
    return lambda f: query(name, GRAPH + sql)(lambda spark, d: f(copurchase(spark, d))) and f


def _n(g) -> int:
    return g.vertices.agg(F.max("id")).first()[0] + 1


def _pairs(g) -> DataFrame:
    return g.edges.where("src < dst").select(F.col("src").alias("v"), F.col("dst").alias("u"))


def _clusters(g) -> DataFrame:
    return g.vertices.select("id", F.pmod("id", F.lit(PARTS)).cast("long").alias("cluster"))


# -- sources, projections, lookups ------------------------------------------------------------------


@graph_query("graph_meta", "SELECT (SELECT count(*) FROM v) nv, (SELECT count(*) FROM e) ne, (SELECT max(d) FROM deg) max_degree, (SELECT count(DISTINCT label) FROM v) classes")
def graph_meta(g):
    v = g.vertices.agg(F.count(F.lit(1)).alias("nv"), F.count_distinct("label").alias("classes"))
    return v.join(G.degrees(g.edges).agg(F.sum("degree").alias("ne"), F.max("degree").alias("max_degree"))).select("nv", "ne", "max_degree", "classes")


@graph_query("degree", "SELECT v.id, CAST(coalesce(d, 0) AS BIGINT) degree FROM v LEFT JOIN deg ON v.id = deg.id")
def degree(g):
    return G.all_degrees(g.vertices, g.edges)


@graph_query("neighbours", "SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) n, dst nbr FROM e")
def neighbours(g):
    return G.neighbours(g.edges)


@graph_query("nth_neighbour", "SELECT src, nbr FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 n, dst nbr FROM e) WHERE n = 2")
def nth_neighbour(g):
    return G.neighbours(g.edges).where("n = 2").select("src", "nbr")


@graph_query("out_neighbours_from", "SELECT src, nbr FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 n, dst nbr FROM e) WHERE n >= 100")
def out_neighbours_from(g):
    return G.neighbours(g.edges).where("n >= 100").select("src", "nbr")


@graph_query("in_neighbours", "SELECT dst id, src nbr FROM dag")
def in_neighbours(g):
    return G.reverse(G.orient(g.edges)).toDF("id", "nbr")


@graph_query("edge_exists", "SELECT v.id src, v.id + 1 dst, e.src IS NOT NULL connected FROM v LEFT JOIN e ON e.src = v.id AND e.dst = v.id + 1")
def edge_exists(g):
    return G.connected_pairs(g.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), g.edges)


@graph_query("orient", "SELECT src, dst FROM dag")
def orient(g):
    return G.orient(g.edges)


@graph_query("edge_list", "SELECT src, dst FROM e WHERE src <> dst")
def edge_list(g):
    return G.edge_list(g.edges)


@graph_query("edgelist_asc", "SELECT src, dst FROM e WHERE src < dst")
def edgelist_asc(g):
    return G.edge_list(g.edges, True, True)


@graph_query("edgelist_desc", "SELECT src, dst FROM e WHERE src > dst")
def edgelist_desc(g):
    return G.edge_list(g.edges, True, False)


@graph_query("edgelist_split", "SELECT src, dst, CAST(floor((row_number() OVER (ORDER BY src, dst) - 1) / ceil((SELECT count(*) FROM e) / 4.0)) AS BIGINT) device FROM e")
def edgelist_split(g):
    """Contiguous ranges of ceil(E / k) edges in order."""
    total = g.edges.agg(F.ceil(F.count(F.lit(1)) / PARTS).alias("m"))
    rows = A.ranked(g.edges.select("src", "dst"), [], ["src", "dst"], "r").join(F.broadcast(total))
    return rows.select("src", "dst", F.floor(F.col("r") / F.col("m")).alias("device"))


@graph_query("edge_at", "SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) e, src, dst FROM e")
def edge_at(g):
    return G.numbered_edges(g.edges)


@graph_query("valid_vertex", "SELECT id - 5 q, id - 5 >= 0 AND id - 5 < (SELECT n FROM nv) - 10 AS valid FROM v")
def valid_vertex(g):
    return G.valid(g.vertices.select((F.col("id") - 5).alias("q")), "q", _n(g) - 10)


@graph_query("graph_fields", "SELECT true has_label, true has_vlabel, false has_elabel")
def graph_fields(g):
    return g.vertices.sparkSession.createDataFrame([tuple(g.fields().values())], "has_label boolean, has_vlabel boolean, has_elabel boolean")


@graph_query("vertices_by_label", "SELECT id FROM v WHERE label = 7")
def vertices_by_label(g):
    return g.vertices.where(F.col("label") == LABEL).select("id").orderBy("id")


# -- labels -----------------------------------------------------------------------------------------


@graph_query("label_frequency", "SELECT CAST(r.label AS INTEGER) label, CAST(coalesce(c, 0) AS BIGINT) cnt FROM (SELECT unnest(range(0, 51)) label) r LEFT JOIN (SELECT label, count(*) c FROM v GROUP BY label) x ON x.label = r.label")
def label_frequency(g):
    return G.label_frequency(g.vertices, 50)


@graph_query("label_max", "SELECT max(label) max_label, max(c) max_frequency FROM (SELECT label, count(*) c FROM v GROUP BY label)")
def label_max(g):
    return g.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("label").alias("max_label"), F.max("c").alias("max_frequency"))


@graph_query("frequent_labels", "SELECT count(*) n_labels FROM (SELECT label FROM v GROUP BY label HAVING count(*) > 40)")
def frequent_labels(g):
    return G.frequent_labels(g.vertices, THRESHOLD)


@graph_query("freq_vertices", "SELECT id, label FROM v WHERE label IN (SELECT label FROM v GROUP BY label HAVING count(*) >= 40)")
def freq_vertices(g):
    return G.frequent_vertices(g.vertices, THRESHOLD)


@graph_query("label_index", "SELECT v.label, CAST(o.o AS BIGINT) AS offset, CAST(row_number() OVER (PARTITION BY v.label ORDER BY v.id) - 1 AS BIGINT) pos, v.id FROM v JOIN (SELECT label, sum(c) OVER (ORDER BY label) - c o FROM (SELECT label, count(*) c FROM v GROUP BY label)) o ON o.label = v.label")
def label_index(g):
    return G.label_index(g.vertices)


@graph_query("nlf", "SELECT src, v.label, count(*) cnt FROM e JOIN v ON v.id = e.dst GROUP BY src, v.label")
def nlf(g):
    return G.neighbour_labels(g.vertices, g.edges)


# -- set operations -----------------------------------------------------------------------------------

INTERSECT = "SELECT pr.v, pr.u, a.w FROM pr JOIN nl a ON a.v = pr.v JOIN nl b ON b.v = pr.u AND b.w = a.w"
DIFFERENCE = "SELECT pr.v, pr.u, a.w FROM pr JOIN nl a ON a.v = pr.v WHERE a.w <> pr.u AND NOT EXISTS (SELECT 1 FROM nl b WHERE b.v = pr.u AND b.w = a.w)"
INDUCED = "SELECT pr.v, pr.u, a.w FROM pr JOIN nl a ON a.v = pr.v WHERE a.w <> pr.u"
#: Vertex sets: the neighbours of v with an even id, of the pairs whose first vertex has label 7.
MEMBERS = ", ps AS MATERIALIZED (SELECT pr.v, pr.u FROM pr JOIN v ON v.id = pr.v WHERE v.label = 7), ms AS MATERIALIZED (SELECT ps.v, ps.u, e.dst w FROM ps JOIN e ON e.src = ps.v JOIN v ON v.id = e.dst WHERE e.dst % 2 = 0 AND v.label <= 25) "
SET_INTERSECT = MEMBERS + "SELECT ms.v, ms.u, ms.w FROM ms JOIN e ON e.src = ms.u AND e.dst = ms.w"
SET_DIFFERENCE = MEMBERS + "SELECT ms.v, ms.u, ms.w FROM ms WHERE ms.w <> ms.u AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = ms.u AND e.dst = ms.w)"
SET_INDUCED = MEMBERS + "SELECT ms.v, ms.u, ms.w FROM ms WHERE ms.w <> ms.u"


def _members(g) -> tuple[DataFrame, DataFrame]:
    """Pairs and their vertex sets, as MEMBERS has them."""
    pairs = _pairs(g).join(g.vertices.where(F.col("label") == LABEL).select(F.col("id").alias("v")), "v")
    small = g.vertices.where("id % 2 = 0 and label <= 25").select(F.col("id").alias("w"))
    return pairs, pairs.join(g.edges.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v").join(small, "w").select("v", "u", "w")


def _count(rows: str) -> str:
    return f"SELECT pr.v, pr.u, CAST(coalesce(c, 0) AS BIGINT) cnt FROM pr LEFT JOIN (SELECT v, u, count(*) c FROM ({rows}) GROUP BY v, u) x ON x.v = pr.v AND x.u = pr.u"


for _name, _rows, _f in (("intersect", INTERSECT, G.intersect_set), ("difference", DIFFERENCE, G.difference_set), ("difference_edgeinduced", INDUCED, G.difference_edge_induced)):
    graph_query(f"{_name}_set", _rows)(lambda g, f=_f: f(_pairs(g), g.edges, g.vertices, LABEL))
    graph_query(f"{_name}_num", _count(_rows))(lambda g, f=_f: G.set_sizes(_pairs(g), f(_pairs(g), g.edges, g.vertices, LABEL)))


def _set_query(g, f, sizes):
    pairs, members = _members(g)
    rows = f(pairs, g.edges, g.vertices, None, members)
    return G.set_sizes(pairs, rows) if sizes else rows


for _name, _rows, _f in (("intersect", SET_INTERSECT, G.intersect_set), ("difference", SET_DIFFERENCE, G.difference_set), ("difference_edgeinduced", SET_INDUCED, G.difference_edge_induced)):
    graph_query(f"vertexset_{_name}_set", _rows)(lambda g, f=_f: _set_query(g, f, False))
    _sizes = _rows.replace(MEMBERS, MEMBERS + ", rs AS (") + ") SELECT ps.v, ps.u, CAST(coalesce(c, 0) AS BIGINT) cnt FROM ps LEFT JOIN (SELECT v, u, count(*) c FROM rs GROUP BY v, u) x ON x.v = ps.v AND x.u = ps.u"
    graph_query(f"vertexset_{_name}_num", _sizes)(lambda g, f=_f: _set_query(g, f, True))


@graph_query("pattern_4clique", "SELECT count(*) n FROM (SELECT x.v, x.u, x.w, e.dst z FROM (SELECT pr.v, pr.u, a.w FROM pr JOIN nl a ON a.v = pr.v JOIN nl b ON b.v = pr.u AND b.w = a.w) x JOIN nl p ON p.v = x.v JOIN nl q ON q.v = x.u AND q.w = p.w JOIN e ON e.src = x.w AND e.dst = p.w WHERE x.w < p.w)")
def pattern_4clique(g):
    """4-cliques v < u, w < z with w and z of one label: the sets of the pairs chain into those of their third vertices."""
    common = G.intersect_set(_pairs(g), g.edges, g.vertices, LABEL)
    grown = common.toDF("a", "b", "w").join(common.toDF("a", "b", "z"), ["a", "b"]).where("w < z").select(F.struct("a", "b").alias("v"), F.col("w").alias("u"), F.col("z").alias("w"))
    pairs = grown.select("v", "u").distinct()
    return G.intersect_set(pairs, g.edges, g.vertices, LABEL, grown).agg(F.count(F.lit(1)).alias("n"))


@graph_query("edge_intersections", "SELECT dag.src, dag.dst, CAST(coalesce(c, 0) AS BIGINT) cnt FROM dag LEFT JOIN (SELECT x.src, x.dst, count(*) c FROM dag x JOIN dag a ON a.src = x.src JOIN dag b ON b.src = x.dst AND b.dst = a.dst GROUP BY x.src, x.dst) t ON t.src = dag.src AND t.dst = dag.dst")
def edge_intersections(g):
    return G.common_out_neighbours(G.orient(g.edges))


# -- triangles ----------------------------------------------------------------------------------------

TRIANGLES = "SELECT x.src a, x.dst b, y.dst c FROM e x JOIN e y ON y.src = x.dst AND x.src < x.dst AND x.dst < y.dst JOIN e z ON z.src = x.src AND z.dst = y.dst"


@graph_query("triangle_count", f"SELECT count(*) triangles FROM ({TRIANGLES})")
def triangle_count(g):
    return G.triangle_count(g.edges)


@graph_query("triangle_count_join", f"SELECT count(*) triangles FROM ({TRIANGLES})")
def triangle_count_join(g):
    return G.triangle_rows(G.orient(g.edges)).agg(F.count(F.lit(1)).alias("triangles"))


@graph_query("triangle_type13", f"SELECT CAST(sum(CASE WHEN a % 4 = b % 4 OR b % 4 = c % 4 OR a % 4 = c % 4 THEN 1 ELSE 0 END) AS BIGINT) type1, CAST(sum(CASE WHEN a % 4 = b % 4 OR b % 4 = c % 4 OR a % 4 = c % 4 THEN 0 ELSE 1 END) AS BIGINT) type3, count(*) total FROM ({TRIANGLES})")
def triangle_type13(g):
    return G.triangle_types(g.edges, PARTS)


TRIPLES = "FROM (SELECT unnest(range(0, {k})) i) a, (SELECT unnest(range(0, {k})) i) b, (SELECT unnest(range(0, {k})) i) c WHERE a.i < b.i AND b.i < c.i"


@query("triples", f"SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS BIGINT) idx, CAST(a.i AS BIGINT) a, CAST(b.i AS BIGINT) b, CAST(c.i AS BIGINT) c {TRIPLES.format(k=6)}")
def triples(spark, d):
    return P.triples(spark, 6)


@query("triple_index", f"SELECT CAST(a.i AS BIGINT) a, CAST(b.i AS BIGINT) b, CAST(c.i AS BIGINT) c, CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS BIGINT) idx {TRIPLES.format(k=9)}")
def triple_index(spark, d):
    """The index from the triple alone."""
    return P.triples(spark, 9).select("a", "b", "c", P.triple_index("a", "b", "c", 9).alias("idx"))


@graph_query("triangle_push_pull", "SELECT CASE WHEN x.src % 4 = x.dst % 4 THEN 'local' WHEN s.d < coalesce(t.d, 0) THEN 'push' ELSE 'pull' END cls, count(*) triangles FROM dag x JOIN dag y ON y.src = x.dst JOIN dag z ON z.src = x.src AND z.dst = y.dst JOIN od s ON s.id = x.src LEFT JOIN od t ON t.id = x.dst GROUP BY 1")
def triangle_push_pull(g):
    """Triangles by how their first edge is exchanged; the total over classes (and ranks) is the count."""
    return G.push_pull_triangles(G.orient(g.edges), PARTS)


@graph_query("push_pull_classes", "SELECT CASE WHEN x.src % 4 = x.dst % 4 THEN 'local' WHEN s.d < coalesce(t.d, 0) THEN 'push' ELSE 'pull' END cls, count(*) n FROM dag x JOIN od s ON s.id = x.src LEFT JOIN od t ON t.id = x.dst GROUP BY 1")
def push_pull_classes(g):
    return G.push_pull(G.orient(g.edges), PARTS).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@graph_query("push_answer", "SELECT x.src % 4 part_u, x.src u, x.dst % 4 part_v, x.dst v FROM dag x JOIN od s ON s.id = x.src JOIN od t ON t.id = x.dst WHERE s.d < t.d")
def push_answer(g):
    return G.push_answer(G.orient(g.edges), PARTS)


#: H-index iteration from the degrees: a row's h is the most neighbours r with value r or more.
CORENESS = """, c(id, c, it, going) AS (
SELECT id, d, 0, true FROM deg
UNION ALL
SELECT id, h, it + 1, max(CASE WHEN h < c THEN 1 ELSE 0 END) OVER () = 1 FROM (
  SELECT id, c, it, max(least(k, r)) h FROM (
    SELECT x.id, x.c, x.it, least(y.c, x.c) k, row_number() OVER (PARTITION BY x.id ORDER BY least(y.c, x.c) DESC) r
    FROM c x JOIN e ON e.src = x.id JOIN c y ON y.id = e.dst WHERE x.going) GROUP BY id, c, it)
), core AS (SELECT id, min(c) c FROM c GROUP BY id) """


@graph_query("kcore", CORENESS + "SELECT v.id, CAST(coalesce(c, 0) AS BIGINT) coreness FROM v LEFT JOIN core ON core.id = v.id")
def kcore(g):
    return G.coreness(g.vertices, g.edges)


@graph_query("core_length", CORENESS + "SELECT count(*) core_length FROM core WHERE c > 1")
def core_length(g):
    return G.coreness(g.vertices, g.edges).agg(F.count(F.when(F.col("coreness") > 1, 1)).alias("core_length"))


# -- partitions ---------------------------------------------------------------------------------------

HALO = "m AS (SELECT DISTINCT part, id FROM (SELECT CAST(floor(src / ceil(n / 4.0)) AS BIGINT) part, src id FROM e, nv UNION ALL SELECT CAST(floor(src / ceil(n / 4.0)) AS BIGINT), dst FROM e, nv))"


@graph_query("halo_partition", f", {HALO}, k AS (SELECT part, id, CAST(floor(id / ceil(n / 4.0)) AS BIGINT) = part own FROM m, nv), c AS (SELECT a.part, count(*) n_edges FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND b.part = a.part GROUP BY a.part) SELECT k.part, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) masters, CAST(sum(CASE WHEN own THEN 0 ELSE 1 END) AS BIGINT) halo, min(c.n_edges) n_edges FROM k JOIN c ON c.part = k.part GROUP BY k.part")
def halo_partition(g):
    return P.halo_partition(g.edges, _n(g), PARTS)


HALO_LOCAL = f", {HALO}, hl AS MATERIALIZED (SELECT part, id, CAST(row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS BIGINT) AS local, CAST(floor(id / ceil(n / 4.0)) AS BIGINT) = part is_master FROM m, nv)"


@graph_query("halo_vertices", HALO_LOCAL + " SELECT part, id, local, is_master FROM hl")
def halo_vertices(g):
    return P.halo_vertices(g.edges, _n(g), PARTS)


@graph_query("halo_ranges", HALO_LOCAL + " SELECT part, min(local) local_begin, max(local) + 1 local_end FROM hl WHERE is_master GROUP BY part")
def halo_ranges(g):
    return P.halo_ranges(P.halo_vertices(g.edges, _n(g), PARTS))


@graph_query("halo_subgraph", HALO_LOCAL + " SELECT a.part, e.src, e.dst, a.local lsrc, b.local ldst FROM e JOIN hl a ON a.id = e.src JOIN hl b ON b.id = e.dst AND b.part = a.part")
def halo_subgraph(g):
    return P.halo_edges(g.edges, P.halo_vertices(g.edges, _n(g), PARTS))


@graph_query("edge_cut_1d", "SELECT CAST(floor(src / ceil(n / 4.0)) AS BIGINT) part, src, dst FROM e, nv")
def edge_cut_1d(g):
    return P.edge_cut_1d(g.edges, _n(g), PARTS)


@graph_query("induced_subgraph", ", l AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) l FROM v WHERE label <= 25) SELECT src, dst, a.l lsrc, b.l ldst FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst")
def induced_subgraph(g):
    return P.induced(g.edges, g.vertices.where("label <= 25").select("id"))


@graph_query("csr_segment", "SELECT least(CAST(floor(dst / floor(n / 4.0)) AS BIGINT), 3) segment, src, dst FROM e, nv")
def csr_segment(g):
    return P.segments(g.edges, _n(g), PARTS)


@graph_query("cluster_rank", "SELECT id, id % 4 AS cluster, CAST(row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1 AS BIGINT) AS rank FROM v")
def cluster_rank(g):
    return P.cluster_rank(_clusters(g))


@graph_query("partition2d", "SELECT src % 4 ci, dst % 4 cj, count(*) n FROM e GROUP BY 1, 2")
def partition2d(g):
    return P.blocks(g.edges, _clusters(g)).groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"))


@graph_query("fetch_partitions", ", l AS (SELECT id, CAST(row_number() OVER (ORDER BY CASE id % 4 WHEN 2 THEN 0 ELSE 1 END, id) - 1 AS BIGINT) l FROM v WHERE id % 4 IN (2, 0)) SELECT a.l lsrc, b.l ldst FROM e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst")
def fetch_partitions(g):
    """The blocks are written by ci and cj as the 2D sink does; the subgraph's read prunes the others."""
    spark = g.edges.sparkSession
    path = new_path(spark, "blocks")
    write_partitioned(P.blocks(g.edges, _clusters(g)), ["ci", "cj"], path)
    return P.fetch(spark.read.parquet(path), _clusters(g), [2, 0])


@graph_query("partition_stats", "SELECT (SELECT max(c) FROM (SELECT count(*) c FROM v GROUP BY id % 4)) max_nv, (SELECT max(c) FROM (SELECT count(*) c FROM e GROUP BY src % 4)) max_ne, (SELECT count(*) FROM e WHERE src % 4 <> dst % 4) cut")
def partition_stats(g):
    return P.stats(g.edges, _clusters(g))


def _propagated(rounds: int) -> str:
    """Common table expressions p0..p<rounds> of label propagation."""
    steps = ["p0 AS MATERIALIZED (SELECT id, id % 4 AS cluster FROM v)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT p.id, coalesce(b.new, p.cluster) AS cluster FROM p{i} p LEFT JOIN (SELECT src, first(cluster ORDER BY n DESC, cluster) AS new FROM (SELECT e.src, q.cluster, count(*) n FROM e JOIN p{i} q ON q.id = e.dst GROUP BY 1, 2) GROUP BY src) b ON b.src = p.id)")
    return ", " + ", ".join(steps)


@graph_query("label_propagation", _propagated(3) + " SELECT id, cluster FROM p3")
def label_propagation(g):
    return P.label_propagation(g.vertices, g.edges, PARTS)


def _balanced(rounds: int) -> str:
    """Common table expressions p0..p<rounds> of the balanced partition."""
    steps = ["p0 AS MATERIALIZED (SELECT id, id % 4 AS cluster FROM v)"]
    for i in range(rounds):
        votes = f"SELECT e.src id, q.cluster t, count(*) n FROM e JOIN p{i} q ON q.id = e.dst GROUP BY 1, 2"
        best = f"SELECT x.id, p.cluster, first(x.t ORDER BY x.n DESC, x.t) t, max(x.n) m, coalesce(max(CASE WHEN x.t = p.cluster THEN x.n END), 0) h FROM ({votes}) x JOIN p{i} p ON p.id = x.id GROUP BY x.id, p.cluster"
        steps.append(f"l{i} AS MATERIALIZED (SELECT id, cluster, t, row_number() OVER (PARTITION BY cluster, t ORDER BY h - m, id) r FROM ({best}) WHERE m > h)")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT p.id, coalesce(y.t, p.cluster) AS cluster FROM p{i} p LEFT JOIN (SELECT a.id, a.t FROM l{i} a JOIN (SELECT cluster, t, count(*) m FROM l{i} GROUP BY 1, 2) b ON b.cluster = a.t AND b.t = a.cluster WHERE a.r <= b.m) y ON y.id = p.id)")
    return ", " + ", ".join(steps)


@graph_query("balanced_partition", _balanced(3) + " SELECT id, cluster FROM p3")
def balanced_partition(g):
    return P.balanced_partition(g.vertices, g.edges, PARTS)


@graph_query("balanced_partition_stats", _balanced(3) + " SELECT (SELECT max(c) FROM (SELECT count(*) c FROM p3 GROUP BY cluster)) max_nv, (SELECT max(c) FROM (SELECT count(*) c FROM e JOIN p3 ON p3.id = e.src GROUP BY cluster)) max_ne, (SELECT count(*) FROM e JOIN p3 a ON a.id = e.src JOIN p3 b ON b.id = e.dst WHERE a.cluster <> b.cluster) cut")
def balanced_partition_stats(g):
    """The balance and the edges between parts; partition_stats has those of ids mod 4."""
    return P.stats(g.edges, P.balanced_partition(g.vertices, g.edges, PARTS))


@graph_query("degree_positions", "SELECT v.id, CAST(row_number() OVER (ORDER BY coalesce(d, 0), v.id) - 1 AS BIGINT) pos FROM v LEFT JOIN deg ON deg.id = v.id")
def degree_positions(g):
    """Position in (degree, id) order."""
    return A.ranked(G.all_degrees(g.vertices, g.edges), [], ["degree", "id"], "pos").select("id", "pos")


@graph_query("row_pointers", "SELECT v.id, CAST(sum(coalesce(d, 0)) OVER (ORDER BY v.id) - coalesce(d, 0) AS BIGINT) s FROM v LEFT JOIN deg ON deg.id = v.id UNION ALL SELECT (SELECT max(id) + 1 FROM v), (SELECT count(*) FROM e)")
def row_pointers(g):
    """n + 1 of them: the last is the number of edges."""
    return A.scan(G.all_degrees(g.vertices, g.edges), "id", "degree", exclusive=True, total=True)


@graph_query("sort_three", f"SELECT least(x.src, x.dst, y.dst) a, x.src + x.dst + y.dst - least(x.src, x.dst, y.dst) - greatest(x.src, x.dst, y.dst) b, greatest(x.src, x.dst, y.dst) c FROM dag x JOIN dag y ON y.src = x.dst JOIN dag z ON z.src = x.src AND z.dst = y.dst")
def sort_three(g):
    s = F.sort_array(F.array("a", "b", "c"))
    return G.triangle_rows(G.orient(g.edges)).select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


# -- arrays -------------------------------------------------------------------------------------------

CENTS = "CAST(round(value * 100) AS BIGINT)"


def _events(spark, d) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_id").alias("i"), F.round(F.col("value") * 100).cast("long").alias("x"), "user_id", "value")


@query("vec_add", "SELECT event_id i, value + CAST(user_id AS DOUBLE) c FROM events")
def vec_add(spark, d):
    return _events(spark, d).select("i", (F.col("value") + F.col("user_id").cast("double")).alias("c"))


@query("vec_add_tiled", f"SELECT CAST(floor(event_id / 4096) AS BIGINT) tile, CAST(sum({CENTS} + user_id) AS BIGINT) c FROM events GROUP BY 1")
def vec_add_tiled(spark, d):
    return _events(spark, d).select(F.floor(F.col("i") / 4096).alias("tile"), (F.col("x") + F.col("user_id")).alias("c")).groupBy("tile").agg(F.sum("c").alias("c"))


@query("vec_mul", f"SELECT event_id i, {CENTS} * user_id c FROM events")
def vec_mul(spark, d):
    return _events(spark, d).select("i", (F.col("x") * F.col("user_id")).alias("c"))


@query("image_double", "SELECT event_id i, CAST((user_id % 256) * 2 % 256 AS BIGINT) v FROM events")
def image_double(spark, d):
    return _events(spark, d).select("i", F.shiftleft((F.col("user_id") % 256).cast("long"), 1).bitwiseAND(F.lit(255)).alias("v"))


def _matrix(spark, d) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("k", "x"))
    return rows.select("row", F.col("k").cast("long").alias("k"), F.round(F.col("x").cast("double") * 1000).cast("long").alias("v"))


MATMUL = "WITH a AS (SELECT vec_id r, unnest(range(0, 64)) k, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) v FROM embeddings) SELECT CAST(x.k AS BIGINT) AS row, CAST(y.k AS BIGINT) AS col, CAST(sum(x.v * y.v) AS BIGINT) v FROM a x JOIN a y ON x.r = y.r GROUP BY 1, 2"


@query("matmul", MATMUL)
def matmul(spark, d):
    """The Gram matrix of the embedding columns."""
    m = _matrix(spark, d)
    return A.matmul(m.select(F.col("k").alias("r"), F.col("row").alias("k"), "v"), m.select(F.col("row").alias("k"), F.col("k").alias("c"), "v"))


@query("matmul_blocked", MATMUL)
def matmul_blocked(spark, d):
    m = _matrix(spark, d)
    return A.matmul_blocked(m.select(F.col("k").alias("r"), F.col("row").alias("k"), "v"), m.select(F.col("row").alias("k"), F.col("k").alias("c"), "v"), TILE)


MASK1 = {(o,): w for o, w in zip(range(-3, 4), (1, -2, 3, 4, 3, 2, -1))}
MASK2 = {(y, x): (y + 2) * 5 + x - 10 for y in range(-2, 3) for x in range(-2, 3)}
MASK3 = {(c, y, x): (c + 1) * (y + 2) + x for c in range(3) for y in range(-2, 3) for x in range(-2, 3)}


def _taps(mask: dict) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(map(str, (*k, w)))})" for k, w in mask.items()) + ")"


@query("conv1d", f"SELECT a.event_id i, CAST(sum(CAST(round(b.value * 100) AS BIGINT) * t.w) AS BIGINT) p FROM events a CROSS JOIN {_taps(MASK1)} t(o, w) JOIN events b ON b.event_id = a.event_id + t.o GROUP BY 1")
def conv1d(spark, d):
    return A.convolve(_events(spark, d).select("i", F.col("x").alias("v")), MASK1, ["i"])


IMAGE = f"WITH c AS (SELECT CAST(floor(event_id / {WIDTH}) AS BIGINT) h, event_id % {WIDTH} w, {CENTS} v FROM events)"


@query("conv2d", f"{IMAGE} SELECT a.h, a.w, CAST(sum(b.v * t.m) AS BIGINT) p FROM c a CROSS JOIN {_taps(MASK2)} t(y, x, m) JOIN c b ON b.h = a.h + t.y AND b.w = a.w + t.x GROUP BY 1, 2")
def conv2d(spark, d):
    cells = _events(spark, d).select(F.floor(F.col("i") / WIDTH).alias("h"), (F.col("i") % WIDTH).alias("w"), F.col("x").alias("v"))
    return A.convolve(cells, MASK2, ["h", "w"])


IMAGE3 = f"WITH c AS (SELECT event_id % 3 ch, CAST(floor(event_id / {3 * WIDTH}) AS BIGINT) h, CAST(floor(event_id / 3) AS BIGINT) % {WIDTH} w, {CENTS} v FROM events), g AS (SELECT DISTINCT h, w FROM c)"


@query("conv2d_3ch", f"{IMAGE3} SELECT a.h, a.w, CAST(sum(b.v * t.m) AS BIGINT) p FROM g a CROSS JOIN {_taps(MASK3)} t(k, y, x, m) JOIN c b ON b.ch = t.k AND b.h = a.h + t.y AND b.w = a.w + t.x GROUP BY 1, 2")
def conv2d_3ch(spark, d):
    third = F.floor(F.col("i") / 3)
    cells = _events(spark, d).select((F.col("i") % 3).alias("ch"), F.floor(F.col("i") / (3 * WIDTH)).alias("h"), (third % WIDTH).alias("w"), F.col("x").alias("v"))
    return A.convolve(cells, MASK3, ["h", "w"], "ch")


@query("sum_reduce", f"SELECT CAST(sum({CENTS}) AS BIGINT) total FROM events")
def sum_reduce(spark, d):
    return _events(spark, d).agg(F.sum("x").alias("total"))


@query("block_reduce", f"SELECT CAST(floor(event_id / 512) AS BIGINT) block, CAST(sum({CENTS}) AS BIGINT) total FROM events GROUP BY 1")
def block_reduce(spark, d):
    return _events(spark, d).groupBy(F.floor(F.col("i") / 512).alias("block")).agg(F.sum("x").alias("total"))


@query("inclusive_scan", f"SELECT event_id i, CAST(sum({CENTS}) OVER (ORDER BY event_id) AS BIGINT) s FROM events")
def inclusive_scan(spark, d):
    return A.scan(_events(spark, d), "i", "x")


@query("exclusive_scan", f"SELECT event_id i, CAST(sum({CENTS}) OVER (ORDER BY event_id) - {CENTS} AS BIGINT) s FROM events UNION ALL SELECT (SELECT max(event_id) + 1 FROM events), (SELECT CAST(sum({CENTS}) AS BIGINT) FROM events)")
def exclusive_scan(spark, d):
    """n + 1 sums: the last is the total."""
    return A.scan(_events(spark, d), "i", "x", exclusive=True, total=True)


@query("char_histogram", "WITH t AS (SELECT ascii(c) b FROM (SELECT unnest(string_split(text, '')) c FROM documents) WHERE c <> ''), n AS (SELECT b, count(*) c FROM t WHERE b < 128 GROUP BY b) SELECT CAST(r.b AS INTEGER) bin, CAST(coalesce(c, 0) AS BIGINT) cnt FROM (SELECT unnest(range(0, 128)) b) r LEFT JOIN n ON n.b = r.b")
def char_histogram(spark, d):
    return A.histogram(read_table(spark, d, "documents"), "text")


@query("parse_int", "SELECT event_id i, user_id v FROM events")
def parse_int(spark, d):
    """Decimal, octal and hexadecimal spellings parse to the number that was spelled."""
    u = F.col("user_id")
    spelt = F.when(F.col("i") % 3 == 0, F.concat(F.lit("0x"), F.hex(u))).when((F.col("i") % 3 == 1) & (u > 0), F.concat(F.lit("0"), F.conv(u.cast("string"), 10, 8))).otherwise(u.cast("string"))
    return _events(spark, d).select("i", A.parse_int(spelt).alias("v"))


# -- message exchanges --------------------------------------------------------------------------------

PES = "(SELECT unnest(range(0, 4)) pe)"
query("ring_shift", f"SELECT CAST((pe + 1) % 4 AS BIGINT) pe, CAST(pe AS BIGINT) received FROM {PES}")(lambda spark, d: M.ring_shift(spark, PARTS))
query("ring_reduce", f"SELECT CAST(pe AS BIGINT) pe, CAST(6 - pe AS BIGINT) target FROM {PES}")(lambda spark, d: M.ring_reduce(spark, PARTS))
query("broadcast_root", f"SELECT CAST(pe AS BIGINT) pe, CAST(i AS BIGINT) i, CAST(i AS BIGINT) AS data FROM {PES} CROSS JOIN (SELECT unnest(range(0, 32)) i)")(lambda spark, d: M.ring_broadcast(spark, PARTS))
query("all_to_all", f"SELECT CAST(p.pe AS BIGINT) pe, CAST(s.pe AS BIGINT) src, CAST(sum(s.pe + i) AS BIGINT) total FROM {PES} p CROSS JOIN {PES} s CROSS JOIN (SELECT unnest(range(0, 4)) i) GROUP BY 1, 2")(lambda spark, d: M.all_to_all(spark, PARTS))
query("queue_sum", f"SELECT CAST(pe AS BIGINT) pe, CAST(18 AS BIGINT) total FROM {PES}")(lambda spark, d: M.queue_sum(spark, PARTS, 2, 3))
query("linked_queue_sum", f"SELECT CAST(pe AS BIGINT) pe, CAST(3 * 2 * 499500 AS BIGINT) total FROM {PES}")(lambda spark, d: M.queue_sum(spark, PARTS, 2, 1000))
query("stop_flag", f"SELECT CAST(pe AS BIGINT) pe, CAST(CASE WHEN pe = 0 THEN 0 ELSE 1 END AS INTEGER) AS stop FROM {PES}")(lambda spark, d: M.stop_flag(spark, PARTS))
query("ring_copy", f"SELECT CAST(h AS BIGINT) hop, CAST(CASE WHEN h < 4 THEN h ELSE -1 END AS BIGINT) holder, event_id i, user_id x FROM events CROSS JOIN (SELECT unnest(range(0, 5)) h)")(lambda spark, d: M.ring_copy(read_table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("x")), PARTS))
query("mailbox_checksum", "SELECT CAST(sum(degree + dest - i) AS BIGINT) checksum FROM (SELECT degree, dest, unnest(range(0, degree)) i FROM (SELECT (w * 1379 + r) % 512 degree, dest FROM (SELECT unnest(range(0, 7)) w) CROSS JOIN (SELECT unnest(range(0, 8)) r) CROSS JOIN (SELECT unnest(range(0, 4)) dest) WHERE dest <> 2))")(lambda spark, d: M.mailbox_checksum(spark, 4, 7, 8))
SLOTS = f"(SELECT src, dest, CAST(degree * (degree + 1) / 2 AS BIGINT) x FROM (SELECT s.pe src, t.pe dest, ((r + t.pe) * 137) % 16 degree FROM {PES} s CROSS JOIN {PES} t CROSS JOIN (SELECT unnest(range(0, 8)) r) WHERE s.pe <> t.pe))"
query("mailbox_totals", f"SELECT CAST(pe AS BIGINT) pe, CAST((SELECT sum(x) FROM {SLOTS} WHERE src = pe) AS BIGINT) sent, CAST((SELECT sum(x) FROM {SLOTS} WHERE dest = pe) AS BIGINT) received FROM {PES}")(lambda spark, d: M.mailbox_totals(spark, PARTS))
query("thread_counters", "SELECT CAST(4 AS BIGINT) a, CAST(1 AS BIGINT) b")(lambda spark, d: M.thread_counters(spark, PARTS))


@query("resources")
def resources(spark, d):
    """What the session may use: (setting, value)."""
    sc = spark.sparkContext
    found = [("default_parallelism", str(sc.defaultParallelism)), ("executor_memory", sc.getConf().get("spark.executor.memory", "1g")), ("shuffle_partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame(found, "setting string, value string")
