"""Operators on edges(src, dst) and vertices(id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import ranked, scan
from tessera.operators import blocks
from tessera.plans.storage import remove, stored

#: Vertices up to which degrees and values go to all tasks.
MAX_VERTICES = 1 << 21


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def all_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees with 0 for isolated vertices."""
    return vertices.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour arrays. After orientation their length is bounded by the square root of twice the edges."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Long form of the sorted lists: (src, n, nbr), n from 0."""
    return ranked(edges.select("src", F.col("dst").alias("nbr")), ["src"], ["nbr"], "n").select("src", "n", "nbr")


def orient(edges: DataFrame) -> DataFrame:
    """Keep (src, dst) if dst has the larger degree, or the same and the larger id: one of each pair, without cycles."""
    d = degrees(edges)
    x, y = d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    if d.count() <= MAX_VERTICES:
        x, y = F.broadcast(x), F.broadcast(y)
    return edges.join(x, "src").join(y, "dst").where("dd > ds or (dd = ds and dst > src)").select("src", "dst")


def edge_list(edges: DataFrame, symmetry_breaking: bool = False, ascending: bool = True) -> DataFrame:
    kept = edges.where("src <> dst")
    return kept.where("src < dst" if ascending else "src > dst") if symmetry_breaking else kept


def connected_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, connected) for each pair."""
    known = edges.select("src", "dst", F.lit(True).alias("c")).distinct()
    return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("c", F.lit(False)).alias("connected"))


def _labelled(edges: DataFrame, vertices: DataFrame, label: int | None) -> DataFrame:
    """(v, w): neighbours w with the label; any if it is None."""
    e = edges.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    return e if label is None else e.join(vertices.where(F.col("label") == label).select(F.col("id").alias("w")), "w").select("v", "w")


#: Neighbours in one array; longer lists are cut by a hash of the neighbour.
MAX_LIST = 1 << 16


def neighbour_lists(edges: DataFrame, vertices: DataFrame, label: int | None = None) -> tuple[DataFrame, int]:
    """(v, part, ws), the neighbours with the label as arrays, and the number of parts of every list."""
    e = _labelled(edges, vertices, label)
    longest = e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-longest // MAX_LIST) or 1
    return e.groupBy("v", F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("w").alias("ws")), parts


def _sets_of(pairs: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """(v, u, part, ws): N(v) of every pair."""
    return pairs.select("v", "u", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(lists, ["v", "part"])


def vertex_set(pairs: DataFrame, members: DataFrame, vertices: DataFrame, label: int | None, parts: int) -> DataFrame:
    """(v, u, part, ws) of given sets members(v, u, w): those with the label, cut as the neighbour lists are."""
    m = members.select("v", "u", "w")
    if label is not None:
        m = m.join(vertices.where(F.col("label") == label).select(F.col("id").alias("w")), "w")
    m = m.groupBy("v", "u", F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_set("w").alias("ws"))
    return m.join(pairs, ["v", "u"], "left_semi")


def _against(sets: DataFrame, lists: DataFrame, operation) -> DataFrame:
    """(v, u, w) of operation(ws, N(u)) less u itself where asked."""
    other = lists.select(F.col("v").alias("u"), "part", F.col("ws").alias("ns"))
    return sets.join(other, ["u", "part"], "left").select("v", "u", F.explode(operation(F.col("ws"), F.col("ns"))).alias("w"))


def _meet(a, b):
    return F.when(b.isNotNull(), F.array_intersect(a, b))


def _without(a, b):
    return F.when(b.isNull(), F.filter(a, lambda w: w != F.col("u"))).otherwise(F.filter(F.array_except(a, b), lambda w: w != F.col("u")))


def _start(pairs, edges, vertices, label, members):
    lists, parts = neighbour_lists(edges, vertices, label)
    return (_sets_of(pairs, lists, parts) if members is None else vertex_set(pairs, members, vertices, label, parts)), lists


def intersect_set(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, label: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """(v, u, w): w in N(v) and N(u), with the label if one is given.

    With ``members``(v, u, w), a vertex set per pair stands for N(v): results chain into patterns.
    """
    return _against(*_start(pairs, edges, vertices, label, members), _meet)


def difference_set(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, label: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """(v, u, w): w in N(v) (or the pair's ``members``), not in N(u), not u itself."""
    return _against(*_start(pairs, edges, vertices, label, members), _without)


def difference_edge_induced(pairs: DataFrame, edges: DataFrame, vertices: DataFrame, label: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """(v, u, w): w in N(v) (or the pair's ``members``), not u itself; N(u) is not subtracted."""
    if members is None:
        lists, parts = neighbour_lists(edges, vertices, label)
        sets = _sets_of(pairs, lists, parts)
    else:
        sets = vertex_set(pairs, members, vertices, label, 1)
    return sets.select("v", "u", F.explode("ws").alias("w")).where("w <> u")


def set_sizes(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(v, u, cnt) of every pair, 0 where there is no row."""
    counts = rows.groupBy("v", "u").agg(F.count(F.lit(1)).alias("c"))
    return pairs.join(counts, ["v", "u"], "left").select("v", "u", F.coalesce("c", F.lit(0)).cast("long").alias("cnt"))


def valid(ids: DataFrame, column: str, size: int) -> DataFrame:
    """``ids`` with whether the column lies in 0..size-1: the bounds test of vertices and of edge numbers."""
    return ids.withColumn("valid", F.coalesce(F.col(column).between(0, size - 1), F.lit(False)))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(e, src, dst): edges by their number in (src, dst) order."""
    return ranked(edges.select("src", "dst"), [], ["src", "dst"], "e").select("e", "src", "dst")


def common_out_neighbours(dag: DataFrame) -> DataFrame:
    """(src, dst, cnt) of each oriented edge; edges meet in packed blocks of two vertex blocks, no list is sent per edge."""
    return blocks.edge_triangles(dag)


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row: each triangle once. Both lists of an oriented edge are at most about sqrt(2 |E|) long."""
    adj = adjacency(orient(edges))
    left = adj.select(F.explode("nbrs").alias("dst"), F.col("nbrs").alias("a"))
    both = left.join(adj.select(F.col("src").alias("dst"), F.col("nbrs").alias("b")), "dst")
    return both.agg(F.coalesce(F.sum(F.size(F.array_intersect("a", "b"))), F.lit(0)).cast("long").alias("triangles"))


def triangle_rows(dag: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle a -> b, b -> c, a -> c.

    The lists of both ends of an oriented edge meet, so nothing larger than the out-lists (at most about
    sqrt(2 |E|) long) is enumerated; a vertex with many in-edges is a skewed side of one join, which Spark splits.
    """
    adj = adjacency(dag)
    left = adj.select(F.col("src").alias("a"), F.explode("nbrs").alias("b"), F.col("nbrs").alias("x"))
    both = left.join(adj.select(F.col("src").alias("b"), F.col("nbrs").alias("y")), "b")
    return both.select("a", "b", F.explode(F.array_intersect("x", "y")).alias("c"))


def triangle_types(edges: DataFrame, parts: int) -> DataFrame:
    """(type1, type3, total): triangles with two or three vertices in one part (id mod parts), or in three parts.

    Each triangle is met once, in the task of its last two vertices' blocks. Without any, the first two are null, as sums of no rows.
    """
    found = blocks.triangles(orient(edges), blocks.count_types(parts), "type1 long, type3 long")
    return found.agg(F.sum("type1").alias("type1"), F.sum("type3").alias("type3")).select("type1", "type3", F.coalesce(F.col("type1") + F.col("type3"), F.lit(0)).cast("long").alias("total"))


def push_pull(dag: DataFrame, parts: int, edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, cls), or these edges of the dag with it: local if in one part, push if src has the smaller out-degree, else pull."""
    d = degrees(dag)
    x, y = d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    if edges is None:
        edges = dag.select("src", "dst")
    elif d.count() <= MAX_VERTICES:
        x, y = F.broadcast(x), F.broadcast(y)
    rows = edges.join(x, "src").join(y, "dst", "left")
    local = F.pmod("src", F.lit(parts)) == F.pmod("dst", F.lit(parts))
    return rows.select(*edges.columns, F.when(local, "local").when(F.col("ds") < F.coalesce("dd", F.lit(0)), "push").otherwise("pull").alias("cls"))


def push_pull_triangles(dag: DataFrame, parts: int) -> DataFrame:
    """(cls, triangles): triangles by the class of their first edge, of the classes that have any."""
    found = blocks.triangles(dag, blocks.first_edges, "src long, dst long, cnt long")
    return push_pull(dag, parts, found).groupBy("cls").agg(F.sum("cnt").alias("triangles"))


def push_answer(dag: DataFrame, parts: int) -> DataFrame:
    """(part_u, u, part_v, v): the lists that u's owner sends, v of larger out-degree, its own part included."""
    d = degrees(dag)
    x, y = d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    rows = dag.join(x, "src").join(y, "dst").where("ds < dd")
    return rows.select(F.pmod("src", F.lit(parts)).alias("part_u"), F.col("src").alias("u"), F.pmod("dst", F.lit(parts)).alias("part_v"), F.col("dst").alias("v"))


def coreness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coreness): repeat c(v) = min(c(v), H-index of the neighbours' c) from the degrees until nothing changes.

    Up to MAX_VERTICES, the values go to all tasks in each round (see blocks). Beyond, they are joined, and the H-index comes
    from counts per value, so a hub's neighbours are never gathered in one row; rounds start from tables, as estimates of checkpoints multiply.
    """
    edges = edges.where("src <> dst")
    start = degrees(edges)
    if start.count() <= MAX_VERTICES:
        core = blocks.coreness(start, edges)
    else:
        edges = stored(edges.repartition("src").sortWithinPartitions("src", "dst"), "edges")
        core, going = stored(start.select("id", F.col("degree").alias("c")), "core"), True
        while going:
            seen = edges.join(core.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").join(core.select(F.col("id").alias("src"), "c"), "src")
            counts = seen.groupBy("src", "c", F.least("cd", "c").alias("k")).agg(F.count(F.lit(1)).alias("n"))
            at_least = counts.withColumn("m", F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("k"))))
            # largest h with h neighbours of value h or more: between two values the count does not change
            new = at_least.groupBy("src", "c").agg(F.max(F.least("k", "m")).alias("h"))
            new = stored(new.select(F.col("src").alias("id"), F.least("c", "h").alias("c"), (F.col("h") < F.col("c")).alias("changed")), "core")
            going = not new.where("changed").isEmpty()
            remove(core.sparkSession, core._tessera_path)
            core = new
        remove(edges.sparkSession, edges._tessera_path)
    return vertices.select("id").join(core.select("id", "c"), "id", "left").select("id", F.coalesce("c", F.lit(0)).cast("long").alias("coreness"))


def label_frequency(vertices: DataFrame, classes: int) -> DataFrame:
    """(label, cnt) for labels 0..classes, with zeros."""
    counts = vertices.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    slots = vertices.sparkSession.range(classes + 1).select(F.col("id").cast("int").alias("label"))
    return slots.join(counts, "label", "left").select("label", F.coalesce("c", F.lit(0)).cast("long").alias("cnt"))


def frequent_labels(vertices: DataFrame, threshold: int) -> DataFrame:
    """One row: labels with a count strictly over the threshold."""
    return vertices.groupBy("label").count().where(F.col("count") > threshold).agg(F.count(F.lit(1)).alias("n_labels"))


def frequent_vertices(vertices: DataFrame, threshold: int) -> DataFrame:
    """Vertices whose label has a count of at least the threshold."""
    often = vertices.groupBy("label").count().where(F.col("count") >= threshold).select("label")
    return vertices.join(often, "label", "left_semi").select("id", "label")


def label_index(vertices: DataFrame) -> DataFrame:
    """(label, pos, id) with the offset of each label's block: ids grouped by label, ascending."""
    counts = vertices.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    starts = scan(counts, "label", "c", exclusive=True).select("label", F.col("s").cast("long").alias("offset"))
    rows = ranked(vertices.select("label", "id"), ["label"], ["id"], "pos")
    return rows.join(starts, "label").select("label", "offset", "pos", "id")


def neighbour_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, label, cnt): neighbours by label."""
    return edges.join(vertices.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("cnt"))
