"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

Vectors are scaled to unit length. Per table three rounds of random signs and a fast Hadamard
transform rotate them; a vector's bucket is the nearest signed axis. All vectors are posted to their bucket in each of
``TABLES`` tables; a query is sent to the buckets of its nearest signed axes and meets there the vectors
posted to them, which are ranked by their exact inner product in double precision, summed component by component.

How many axes are probed is fitted, for every vector length and norm range: on a sample of the index (at most about ``SAMPLE`` vectors of a
range and ``ASKED`` queries of a length) the pairs that are, by weight, among the ``k`` best of their query are found by brute force,
and the number of probes is the least that reaches the share ``TARGET`` of them in some table. A range without such pairs gets one probe.
A query that finds fewer than ``k + 1`` classes then looks into all buckets.

Norms enter by ranges, powers of two, that are all probed and ranked together: within a range a large
inner product is a small angle up to a factor of two, and vectors of one range never change the
buckets of another.

Equal vectors form one class that is searched once: a query's nearest ids lie among the ``k + 1``
smallest ids of each class. A bucket of more than ``BUCKET`` classes is split into parts by hash, each asked by
all queries of the bucket in blocks of ``QUERIES``, so no bucket, however common, has to fit in a task.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as
queries or as candidates; vectors of different lengths are never compared; ties go to the smaller
vec_id; rows that repeat a vec_id with the same vector count once; null vec_ids take no part; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

TABLES = 4
#: The sample on which probes are fitted, and the share of its best pairs that some table must reach.
SAMPLE, ASKED, TARGET = 2048, 256, 0.95
#: Classes and queries that meet at a time in one bucket.
BUCKET, QUERIES = 8192, 4096
K = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """The pseudo-rotation of table ``which`` of rows whose length is a power of two."""
    rng = np.random.default_rng([which, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


def axes(dim: int) -> int:
    """Signed axes of vectors of a length, padded to a power of two."""
    return 2 << (dim - 1).bit_length()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, axes(d) // 2))
    out[:, :d] = x
    return out / np.sqrt((x * x).sum(1))[:, None]


def buckets(x: np.ndarray) -> np.ndarray:
    axis = np.abs(x).argmax(1)
    return axis * 2 + (x[np.arange(len(x)), axis] < 0)


def by_nearness(x: np.ndarray) -> np.ndarray:
    """Rows' signed axes (2 * axis, plus 1 if negative), nearest first."""
    return np.argsort(-np.stack([x, -x], 2).reshape(len(x), -1), 1, kind="stable")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(q.shape[1]):
        total += x[:, j] * q[:, j]
    return total


def best_in_bucket(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors of each query; more if the last ones tie."""
    rough = q @ x.T
    if len(x) > k:
        least = np.partition(rough, len(x) - k, 1)[:, len(x) - k]
        i, j = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    return i, j, exact(q[i], x[j])


def fitted_probes(scales: np.ndarray, x: np.ndarray, sizes: dict[int, int], k: int, asked: int = ASKED, target: float = TARGET) -> dict[int, int]:
    """By norm range the number of probes that reaches ``target`` of the best pairs of a sample of the index.

    ``sizes`` are the ranges' sizes in the whole index: a sampled vector counts for as many as it stands for.
    """
    rng = np.random.default_rng(0)
    stands = {e: sizes[e] / max(1, int((scales == e).sum())) for e in sizes}
    weight = np.array([stands[e] for e in scales.tolist()])
    chosen = rng.choice(len(x), min(asked, len(x)), False, weight / weight.sum())
    score = x[chosen] @ x.T
    score[np.arange(len(chosen)), chosen] = -np.inf
    order = np.argsort(-score, 1)
    before = np.cumsum(weight[order], 1) - weight[order]
    row, place = np.nonzero(before < k)
    of = order[row, place]
    keep = of != chosen[row]
    row, of = row[keep], of[keep]
    base = unit(x)
    rank = np.full(len(of), 2 * base.shape[1])
    for t in range(TABLES):
        turned = rotated(base, t)
        near = np.argsort(by_nearness(turned[chosen]), 1)  # place of every signed axis
        rank = np.minimum(rank, near[row, buckets(turned)[of]])
    probes = {}
    for e in sizes:
        some = scales[of] == e
        by = np.argsort(rank[some])
        share = np.cumsum(weight[of[some]][by])
        probes[e] = int(rank[some][by][np.searchsorted(share, target * share[-1])]) + 1 if some.any() else 1
    return probes


def _finite(column: str):
    return F.forall(column, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))


def vector_classes(df: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """Written: cid (least id), ids (the k + 1 least), dim, scale (power of two of the norm), v, of distinct valid vectors."""
    v = F.col(embedding).cast("array<double>")
    valid = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    valid = valid.where(_finite("v") & F.exists("v", lambda c: c != 0))
    keyed = valid.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    first = Window.partitionBy("k1", "k2").orderBy("id")
    top = keyed.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    grouped = top.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.sort_array(F.collect_set("id")).alias("ids"), F.max_by("v", -F.col("r")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c))
    scale = F.coalesce(F.floor(F.log2(norm)), F.lit(0)).cast("long").alias("scale")
    return written(grouped.select("cid", "ids", F.size("v").alias("dim"), scale, "v", "k1", "k2"), "vector-classes")


POSTED = "dim int, scale long, tab int, bucket int, cid long, v array<double>"


def posted(vectors: DataFrame, probes: dict[int, dict[int, int]] | None = None) -> DataFrame:
    """POSTED rows of vectors(cid, dim, scale, v): to their own bucket of each table, or with ``probes``, by dim and
    scale, to those that a query looks up in every range."""
    names = [x.split()[0] for x in POSTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                for at in range(0, int((dims == dim).sum()), 512):
                    rows = batch.take(pa.array(np.flatnonzero(dims == dim)[at : at + 512]))
                    cid, scale, v = rows.column("cid").to_numpy(), rows.column("scale").to_numpy(), rows.column("v")
                    x = v.flatten().to_numpy().reshape(len(cid), dim)
                    base = unit(x)
                    for t in range(TABLES):
                        turned = rotated(base, t)
                        if probes is None:
                            found = [(np.arange(len(cid)), scale, buckets(turned))]
                        else:
                            near = by_nearness(turned)
                            found = [(np.repeat(np.arange(len(cid)), n), np.full(len(cid) * n, e), near[:, :n].ravel()) for e, n in probes[int(dim)].items()]
                        for of, e, bucket in found:
                            columns = [pa.array(np.full(len(of), dim, np.int32)), pa.array(e.astype(np.int64)), pa.array(np.full(len(of), t, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(cid[of]), v.take(pa.array(of))]
                            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select("cid", "dim", "scale", "v").mapInArrow(run, POSTED)


def looked_up(classes: DataFrame, who: DataFrame, probes: dict[int, dict[int, int]], k: int, bucket: int) -> DataFrame:
    """(qcid, cid, score): the k + 1 best classes that each query class of ``who`` meets in the buckets it probes."""
    place = ["dim", "scale", "tab", "bucket"]
    index, wanted = posted(classes), posted(who, probes)
    # how many parts a bucket has, and into how many blocks its queries fall: at most a row for each signed axis, table and range
    counts = written(index.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "buckets")
    asks = written(wanted.groupBy(*place).agg(F.count(F.lit(1)).alias("m")), "probes")
    held = F.broadcast(counts.join(asks, place).select(*place, F.ceil(F.col("n") / bucket).cast("int").alias("parts"), F.ceil(F.col("m") / QUERIES).cast("int").alias("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(F.lit(2), "cid"), F.col(n)).cast("int")
    base = index.join(held, place).select(*place, "cid", "v", F.lit(False).alias("query"), own("parts").alias("part"), every("blocks").alias("block"))
    ask = wanted.join(held, place).select(*place, "cid", "v", F.lit(True).alias("query"), every("parts").alias("part"), own("blocks").alias("block"))

    def run(key, group):
        query, ids = group.column("query").to_numpy(), group.column("cid").to_numpy()
        vectors = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if query.any() and not query.all():
            qid, cid, q, x = ids[query], ids[~query], vectors[query], vectors[~query]
            for at in range(0, len(qid), 256):
                i, j, score = best_in_bucket(q[at : at + 256], x, k + 1)
                for column, found in zip(out, (qid[at + i], cid[j], score)):
                    column.append(found)
        return pa.table({"qcid": np.concatenate(out[0]), "cid": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    found = base.union(ask).groupBy(*place, "part", "block").applyInArrow(run, "qcid long, cid long, score double")
    by_class = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    # k + 1 classes hold the k + 1 nearest ids: each class names its least id first; a class may come from several tables
    return found.withColumn("r", F.dense_rank().over(by_class)).where(F.col("r") <= k + 1).drop("r").distinct()


def nearest(df: DataFrame, vec_id: str, embedding: str, queries, k: int = K, bucket: int = BUCKET, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which the condition ``queries`` holds, against all rows."""
    spark = df.sparkSession
    classes = vector_classes(df, vec_id, embedding, k)
    sizes: dict[int, dict[int, int]] = {}
    for r in classes.groupBy("dim", "scale").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each vector length and power of two
        sizes.setdefault(r["dim"], {})[r["scale"]] = r["n"]
    thin = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("scale") == e), -(-n // SAMPLE)) for d, of in sizes.items() for e, n in of.items()], F.lit(1))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), thin) == 0).select("dim", "scale", "v").toArrow()  # about SAMPLE rows a range
    probes: dict[int, dict[int, int]] = {}
    for dim, of in sizes.items():
        rows = sample.filter(pa.array(sample.column("dim").to_numpy() == dim)) if sample.num_rows else sample
        if rows.num_rows:
            x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            probes[dim] = fitted_probes(rows.column("scale").to_numpy(), x, of, k, target=target)
        else:
            probes[dim] = {e: axes(dim) for e in of}
    v = F.col(embedding).cast("array<double>")
    asked = df.where(queries).select(F.col(vec_id).cast("long").alias("query_id"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2")).where("query_id is not null").distinct()
    asked = asked.join(classes.select("k1", "k2", "cid"), ["k1", "k2"]).select("query_id", F.col("cid").alias("qcid"))
    asked = written(asked, "queries")
    who = classes.join(asked.select(F.col("qcid").alias("cid")).distinct(), "cid", "left_semi")

    best = written(looked_up(classes, who, probes, k, bucket), "found")
    # a query with fewer classes than it wants, of those there are, looks into every bucket
    total = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("total"))
    short = who.join(best.groupBy(F.col("qcid").alias("cid")).agg(F.count(F.lit(1)).alias("n")), "cid", "left").join(F.broadcast(total), "dim")
    short = written(short.where(F.coalesce("n", F.lit(0)) < F.least("total", F.lit(k + 1))).select(who.columns), "short")
    if not short.isEmpty():
        every_axis = {dim: {e: axes(dim) for e in of} for dim, of in sizes.items()}
        best = best.join(short.select(F.col("cid").alias("qcid")), "qcid", "left_anti").union(looked_up(classes, short, every_axis, k, bucket))
    listed = best.join(classes.select("cid", "ids"), "cid").select("qcid", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("qcid").orderBy(F.desc("score"), "vec_id")
    top = listed.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    lists = top.groupBy("qcid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = asked.join(lists, "qcid").select("query_id", F.posexplode(others).alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
