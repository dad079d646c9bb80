"""Graph partitioning: ranges with halos, destination segments, 2D blocks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import ranked
from tessera.plans.storage import checkpointed


def range_part(column, n: int, k: int):
    """Part of a vertex 0..n-1 among k ranges of ceil(n / k)."""
    return F.floor(F.col(column) / -(-n // k))


def halo_members(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(part, id, is_master): the vertices of each range that have an edge, and their neighbours."""
    masters = edges.select(range_part("src", n, k).alias("part"), F.col("src").alias("id"))
    near = edges.select(range_part("src", n, k).alias("part"), F.col("dst").alias("id"))
    return masters.union(near).distinct().select("part", "id", (range_part("id", n, k) == F.col("part")).alias("is_master"))


def _inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(part, src, dst): edges with both ends in a part. An end's parts travel as one array, so an edge is not copied."""
    parts = members.groupBy("id").agg(F.collect_set("part").alias("p"))
    both = edges.join(parts.toDF("src", "ps"), "src").join(parts.toDF("dst", "pd"), "dst")
    return both.select(F.explode(F.array_intersect("ps", "pd")).alias("part"), "src", "dst")


def halo_partition(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(part, masters, halo, n_edges) of the subgraphs induced by each range and its neighbours."""
    m = halo_members(edges, n, k)
    inside = _inside(edges, m).groupBy("part").agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = m.groupBy("part").agg(F.count(F.when(F.col("is_master"), 1)).alias("masters"), F.count(F.when(~F.col("is_master"), 1)).alias("halo"))
    return sizes.join(inside, "part").select("part", "masters", "halo", "n_edges")


def halo_vertices(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(part, id, local, is_master): dense local ids by ascending id."""
    return ranked(halo_members(edges, n, k), ["part"], ["id"], "local").select("part", "id", "local", "is_master")


def halo_ranges(local: DataFrame) -> DataFrame:
    """(part, local_begin, local_end) of halo_vertices: the masters are the local ids from begin up to, without, end."""
    own = local.where("is_master")
    return own.groupBy("part").agg(F.min("local").alias("local_begin"), (F.max("local") + 1).alias("local_end"))


def halo_edges(edges: DataFrame, local: DataFrame) -> DataFrame:
    """(part, src, dst, lsrc, ldst): the edges of every part of halo_vertices, halo to halo included."""
    of = local.select("part", "id", "local")
    rows = _inside(edges, of)
    return rows.join(of.toDF("part", "src", "lsrc"), ["part", "src"]).join(of.toDF("part", "dst", "ldst"), ["part", "dst"]).select("part", "src", "dst", "lsrc", "ldst")


def edge_cut_1d(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(part, src, dst): every edge with the range of its source."""
    return edges.select(range_part("src", n, k).alias("part"), "src", "dst")


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends in chosen(id), with dense local ids by ascending id: (src, dst, lsrc, ldst)."""
    local = ranked(chosen.select("id"), [], ["id"], "l")
    return edges.join(local.toDF("src", "lsrc"), "src").join(local.toDF("dst", "ldst"), "dst").select("src", "dst", "lsrc", "ldst")


def segments(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(segment, src, dst): by range of the destination, the last one taking the rest."""
    return edges.select(F.least(F.floor(F.col("dst") / (n // k)), F.lit(k - 1)).cast("long").alias("segment"), "src", "dst")


def cluster_rank(clusters: DataFrame) -> DataFrame:
    """(id, cluster, rank): ordinal of a vertex in its cluster, from 0."""
    return ranked(clusters.select("id", "cluster"), ["cluster"], ["id"], "rank")


def blocks(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ci, cj, src, dst): the 2D block of every edge."""
    c = clusters.select("id", "cluster")
    return edges.join(c.toDF("src", "ci"), "src").join(c.toDF("dst", "cj"), "dst").select("ci", "cj", "src", "dst")


def fetch(stored: DataFrame, clusters: DataFrame, chosen: list[int]) -> DataFrame:
    """(lsrc, ldst): subgraph of the chosen clusters, local ids by the clusters' order and then by rank.

    ``stored`` has the partition columns ci and cj of the 2D sink; only the chosen blocks are read.
    """
    edges = stored.where(F.col("ci").isin(chosen) & F.col("cj").isin(chosen)).select("src", "dst")
    order = F.coalesce(*[F.when(F.col("cluster") == c, i) for i, c in enumerate(chosen)])
    some = clusters.where(F.col("cluster").isin(chosen)).select("id", order.alias("o"))
    local = ranked(some, [], ["o", "id"], "l").select("id", "l")
    return edges.join(local.toDF("src", "lsrc"), "src").join(local.toDF("dst", "ldst"), "dst").select("lsrc", "ldst")


def stats(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the most vertices and edges of a cluster that owns its vertices' lists, and the cut edges."""
    c = clusters.select("id", "cluster")
    nv = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("nv")).agg(F.max("nv").alias("max_nv"))
    b = blocks(edges, clusters)
    ne = b.groupBy("ci").agg(F.count(F.lit(1)).alias("ne"), F.count(F.when(F.col("ci") != F.col("cj"), 1)).alias("cut")).agg(F.max("ne").alias("max_ne"), F.sum("cut").alias("cut"))
    return nv.join(ne).select("max_nv", "max_ne", "cut")


def label_propagation(vertices: DataFrame, edges: DataFrame, k: int, rounds: int = 3) -> DataFrame:
    """(id, cluster): parts by hash, then each vertex takes its neighbours' most common one, ties to the least.

    A distributed stand-in for a min-cut partitioner; any map gives the same triangles.
    """
    parts = vertices.select("id", F.pmod("id", F.lit(k)).alias("cluster"))
    for _ in range(rounds):
        votes = edges.join(parts.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy("src", "cluster").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("new"))
        parts = parts.join(best, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
    return parts


def balanced_partition(vertices: DataFrame, edges: DataFrame, k: int, rounds: int = 3) -> DataFrame:
    """(id, cluster): parts of equal size (to one vertex) with few edges between them.

    Starts from ids mod k. In a round every vertex that has more neighbours in another part than in its own wants
    to move to the part that holds most; of each two parts, as many vertices change sides one way as the
    other, those that gain most first, so sizes never change.
    """
    parts = checkpointed(vertices.select("id", F.pmod("id", F.lit(k)).cast("long").alias("cluster")))
    for _ in range(rounds):
        votes = edges.join(parts.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), F.col("cluster").alias("to")).agg(F.count(F.lit(1)).alias("n"))
        seen = votes.join(parts, "id")
        best = seen.groupBy("id", "cluster").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"), F.max("n").alias("most"), F.coalesce(F.max(F.when(F.col("to") == F.col("cluster"), F.col("n"))), F.lit(0)).alias("here"))
        wish = best.where("most > here").select("id", "cluster", "to", (F.col("here") - F.col("most")).alias("loss"))
        line = ranked(wish, ["cluster", "to"], ["loss", "id"], "place")
        sizes = line.groupBy("cluster", "to").agg(F.count(F.lit(1)).alias("m"))  # at most k * k rows
        back = sizes.select(F.col("cluster").alias("to"), F.col("to").alias("cluster"), F.col("m").alias("room"))
        moves = line.join(F.broadcast(back), ["cluster", "to"]).where("place < room").select("id", "to")
        parts = checkpointed(parts.join(moves, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
    return parts


def triples(spark: SparkSession, k: int) -> DataFrame:
    """(idx, a, b, c): the C(k, 3) sorted triples of k parts and their index in lexicographic order."""
    r = spark.range(k)
    rows = r.toDF("a").join(r.toDF("b"), F.col("a") < F.col("b")).join(r.toDF("c"), F.col("b") < F.col("c"))
    return ranked(rows, [], ["a", "b", "c"], "idx").select("idx", "a", "b", "c")


def triple_index(a: str, b: str, c: str, k: int):
    """The index of a sorted triple: all triples less those from (a, b, c) on."""
    three = (k - F.col(a)) * (k - F.col(a) - 1) * (k - F.col(a) - 2) / 6
    two = (k - F.col(b)) * (k - F.col(b) - 1) / 2
    rest = (k - 1 - F.col(a)) * (k - 2 - F.col(a)) / 2
    return (F.lit(k * (k - 1) * (k - 2) / 6) - three + rest - two + F.col(c) - F.col(b) - 1).cast("long")
