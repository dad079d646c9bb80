"""Graph and array sources and sinks: tables, raw CSR files, partitioned Parquet, text, random vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import ranked
from tessera.functions.packing import block_of, bounded, buffered, dealt, expand, grouped, unpack
from tessera.plans.storage import stored

#: Fixed widths of the raw files: row pointers, column indices, vertex lists and part maps.
ROWPTR, COLIDX, VERTEX_LIST = "<i8", "<i4", "<i8"
PARTITION_META_FIELDS = ["nv", "n_real", "ne", "max_subg_nv", "max_subg_ne", "max_degree"]
#: Vertices of the part map that goes to every writer of raw parts (8 bytes each).
MAX_MAP = 1 << 24
META_FIELDS = ["nv", "ne", "vid_size", "eid_size", "vlabel_size", "elabel_size", "max_degree", "feat_len", "nvclasses", "neclasses"]


@dataclass(frozen=True)
class Graph:
    """``vertices(id, label)`` and ``edges(src, dst)``; undirected graphs hold both directions."""

    vertices: DataFrame
    edges: DataFrame

    def fields(self) -> dict[str, bool]:
        """Which optional data the graph has."""
        vlabel, elabel = "label" in self.vertices.columns, "label" in self.edges.columns
        return {"has_label": vlabel or elabel, "has_vlabel": vlabel, "has_elabel": elabel}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], DataFrame] = {}


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are vertices, labelled by size; two parts of one order are joined.

    The edges are built once per application and input folder and kept as a table in the shared folder, as a
    stored graph; later queries read that.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("label"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_partkey").cast("long").alias("p"))
    if key not in _STORED:
        _STORED[key] = stored(joined_in_groups(lines.where("o is not null and p is not null")), "graph", **DELTA)
    return Graph(part, _STORED[key])


#: Sorted longs are stored as differences.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
#: Pairs made at a time, and blocks of vertices whose edges are made distinct together.
AT_ONCE, BLOCKS = 1 << 21, 1 << 10


def joined_in_groups(lines: DataFrame) -> DataFrame:
    """edges(src, dst): distinct p, in both directions, that share an o in lines(o, p); sorted within blocks of src.

    Lines are shuffled once; pairs travel as packed blocks. An order of k parts makes k * k edges, so its k parts fit a task where its edges do.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []  # an order may go on in the next batch
        for o, p in itertools.chain(buffered(batches, 1 << 18), [(None, None)]):
            if o is None:
                done, rest = rest, []
            else:
                cut = int(np.searchsorted(o, o[-1]))
                done, rest = (rest + [(o[:cut], p[:cut])], [(o[cut:], p[cut:])]) if cut or (rest and rest[-1][0][-1] != o[0]) else ([], rest + [(o, p)])
            if done:
                yield from packed(*(np.concatenate(c) for c in zip(*done)))

    def packed(o, p):
        new = np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1])][: len(o)]
        o, p = o[new], p[new]
        first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]][: len(o)])
        size = np.diff(np.r_[first, len(o)])
        start, length = np.repeat(first, size), np.repeat(size, size)
        for part in bounded(length, AT_ONCE):
            of, at = expand(length[part])
            src, dst = p[part][of], p[start[part][of] + at]
            kept = src != dst
            yield from blocks(src[kept], dst[kept])

    def blocks(src, dst):
        rows = list(dealt(block_of(src, BLOCKS), src, dst))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["block", "src", "dst"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            src, dst = (np.concatenate([unpack(r[c]) for r in rows]) for c in (1, 2))
            order = np.lexsort((dst, src))
            src, dst = src[order], dst[order]
            new = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(src[new]), pa.array(dst[new])], ["src", "dst"])

    made = lines.repartition("o").sortWithinPartitions("o", "p").mapInArrow(pairs, "block int, src binary, dst binary")
    return made.repartition("block").sortWithinPartitions("block").mapInArrow(distinct, "src long, dst long")


def from_edges(spark: SparkSession, pairs: list[tuple[int, int]], n: int | None = None) -> Graph:
    """A graph of stated directed edges on vertices 0..n-1, all of label 0."""
    n = n if n is not None else 1 + max((max(p) for p in pairs), default=-1)
    vertices = spark.range(n).select("id", F.lit(0).alias("label"))
    return Graph(vertices, spark.createDataFrame(pairs, "src long, dst long"))


def read_meta(spark: SparkSession, prefix: str, bipartite: bool = False, partition: int | None = None) -> DataFrame:
    """One row of the fields of ``<prefix>.meta.txt``; a bipartite one starts with the two sides' sizes.

    With ``partition``, those of ``<prefix><partition>.meta.txt``, one rank's part of a graph.
    """
    fields = (["nv_left", "nv_right"] + META_FIELDS[1:]) if bipartite else META_FIELDS
    if partition is not None:
        fields, prefix = PARTITION_META_FIELDS, f"{prefix}{partition}"
    words = F.filter(F.split(F.col("value"), r"\s+"), lambda w: w != "")
    row = spark.read.text(f"{prefix}.meta.txt", wholetext=True).select(words.alias("w"))
    return row.select(*[F.get("w", i).cast("long").alias(f) for i, f in enumerate(fields)])


def read_csr(spark: SparkSession, prefix: str) -> DataFrame:
    """edges(src, dst) of ``<prefix>.vertex.bin`` and ``.edge.bin``. A CSR pair is decoded by one task."""
    files = spark.read.format("binaryFile").load([f"{prefix}.vertex.bin", f"{prefix}.edge.bin"])
    both = files.agg(F.max(F.when(F.col("path").endswith(".vertex.bin"), F.col("content"))).alias("rows"), F.max(F.when(F.col("path").endswith(".edge.bin"), F.col("content"))).alias("cols"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows, cols in zip(frame["rows"], frame["cols"]):
                ptr, idx = np.frombuffer(rows, ROWPTR), np.frombuffer(cols, COLIDX)
                src = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                for at in range(0, len(idx), 1 << 20):
                    yield pd.DataFrame({"src": src[at : at + (1 << 20)], "dst": idx[at : at + (1 << 20)].astype(np.int64)})

    return both.mapInPandas(decode, "src long, dst long")


def read_labels(spark: SparkSession, path: str, vertices: DataFrame, classes: int) -> DataFrame:
    """vertices(id, label) from a file of one byte per vertex, or ``1 + hash(id) mod classes`` if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return vertices.select("id", (F.pmod(F.xxhash64("id"), F.lit(classes)) + 1).cast("int").alias("label"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                labels = np.frombuffer(content, np.uint8)
                yield pd.DataFrame({"id": np.arange(len(labels)), "label": labels.astype(np.int32)})

    labels = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "id long, label int")
    found = labels.select("label").distinct().count()
    if found != classes:
        raise ValueError(f"{found} labels in {path}, {classes} stated")
    return vertices.select("id").join(labels, "id")


def _numbers(spark: SparkSession, path: str, width: str, name: str) -> DataFrame:
    """(n, name): the numbers of a raw file and their places. A file is decoded by one task."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                values = np.frombuffer(content, width)
                for at in range(0, len(values), 1 << 20):
                    part = values[at : at + (1 << 20)].astype(np.int64)
                    yield pd.DataFrame({"n": np.arange(at, at + len(part)), name: part})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, f"n long, {name} long")


def read_partition(spark: SparkSession, prefix: str, rank: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One rank's part of a graph: edges(src, dst), its own vertices(n, id), and the map (id, part) of all."""
    own = f"{prefix}{rank}"
    parts = _numbers(spark, f"{own}.part.bin", VERTEX_LIST, "part").withColumnRenamed("n", "id")
    return read_csr(spark, own), _numbers(spark, f"{own}.vertex_list.bin", VERTEX_LIST, "id"), parts


def read_edge_labels(spark: SparkSession, path: str, edges: DataFrame, classes: int) -> DataFrame:
    """edges(src, dst, label) from a file of one byte per edge in (src, dst) order.

    Without a file, ``1 + hash(src, dst) mod classes``, or 1 if no classes are stated.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return edges.select("src", "dst", (F.pmod(F.xxhash64("src", "dst"), F.lit(max(classes, 1))) + 1).cast("int").alias("label"))
    labels = _numbers(spark, path, "u1", "label")
    found = labels.select("label").distinct().count()
    if found > classes:
        raise ValueError(f"{found} labels in {path}, {classes} stated")
    return ranked(edges.select("src", "dst"), [], ["src", "dst"], "n").join(labels, "n").select("src", "dst", F.col("label").cast("int").alias("label"))


def write_partitioned(edges: DataFrame, parts: list[str], path: str) -> None:
    """Edges as Parquet folders by partition columns, which later reads prune."""
    edges.repartition(*parts).write.partitionBy(*parts).parquet(path)


def write_raw_partitions(edges: DataFrame, parts: DataFrame, nv: int, prefix: str) -> None:
    """The raw files that ``read_partition`` reads, for every part of parts(id, part): ``<prefix><part>.*``.

    A part owns the lists of its vertices; row pointers have nv + 1 entries and ids stay global. Each array
    is written as ``.bin`` and as ``.txt``, the lists also as ``.csr.txt``. A task holds the row pointers and vertex list of the
    part it writes; edges stream through it in order.
    """
    from pyarrow import fs as pafs

    owned = parts.select(F.col("id").alias("src"), "part")
    rows = owned.join(edges, "src", "left").select("part", "src", "dst")
    found = rows.groupBy("part").agg(F.count_distinct("src").alias("nv"), F.count("dst").alias("ne"))
    most = found.agg(F.max("nv").alias("nv"), F.max("ne").alias("ne")).first()
    if nv > MAX_MAP:
        raise ValueError(f"every raw part holds the whole part map, so there may be {MAX_MAP} vertices at most")
    known, of = parts.select("id", "part").toArrow(), np.zeros(nv, VERTEX_LIST)
    of[known.column("id").to_numpy()] = known.column("part").to_numpy()
    owner = edges.sparkSession.sparkContext.broadcast(of)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close() -> int:
            degrees, own, part = state["degrees"], np.array(state["own"], VERTEX_LIST), state["part"]
            ptr = np.r_[0, np.cumsum(degrees)].astype(ROWPTR)
            for name, values in (("vertex", ptr), ("vertex_list", own), ("part", owner.value)):
                with fs.open_output_stream(f"{base}{part}.{name}.bin") as out:
                    out.write(values.tobytes())
                with fs.open_output_stream(f"{base}{part}.{name}.txt") as out:
                    out.write("".join(f"{x}\n" for x in values.tolist()).encode())
            for out in state["out"].values():
                out.close()
            meta = [nv, len(own), int(ptr[-1]), most["nv"], most["ne"], int(degrees.max(initial=0))]
            with fs.open_output_stream(f"{base}{part}.meta.txt") as out:
                out.write(("\n".join(map(str, meta)) + "\n").encode())
            return part

        fs, base = pafs.FileSystem.from_uri(prefix)
        for frame in frames:
            for part, rows_of in frame.groupby("part", sort=False):
                if state.get("part") != part:
                    if state:
                        yield pd.DataFrame({"part": [close()]})
                    state = {"part": int(part), "degrees": np.zeros(nv, np.int64), "own": [], "out": {x: fs.open_output_stream(f"{base}{part}.{x}") for x in ("edge.bin", "edge.txt", "csr.txt")}}
                for src, of in rows_of.groupby("src", sort=False):
                    dst = of["dst"].dropna().astype(np.int64).to_numpy()
                    if not state["own"] or state["own"][-1] != src:
                        state["own"].append(int(src))
                    state["degrees"][src] += len(dst)
                    state["out"]["edge.bin"].write(dst.astype(COLIDX).tobytes())
                    state["out"]["edge.txt"].write("".join(f"{x}\n" for x in dst.tolist()).encode())
                    state["out"]["csr.txt"].write((f"{src}: " + " ".join(map(str, dst.tolist())) + "\n").encode())
        if state:
            yield pd.DataFrame({"part": [close()]})

    rows.repartition("part").sortWithinPartitions("part", "src", "dst").mapInPandas(write, "part long").count()


def read_text(spark: SparkSession, path: str, length: int = 1_000_000, seed: int = 0) -> DataFrame:
    """The lines of a text file; where there is none, one of ``length`` random characters 0..127 is written first.

    Generated text is written by many tasks, a line of up to 1,000 characters a row; line ends count as characters.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        char = lambda i: F.char(F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(128)))
        rows = spark.range(-(-length // 1000)).select("id", F.least(F.lit(999), length - F.col("id") * 1000 - 1).cast("int").alias("n"))
        line = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.col("n")), char))
        # characters 10 and 13 would end a line
        rows.select(F.when(F.col("n") > 0, F.translate(line, "\n\r", "  ")).otherwise("").alias("value")).write.text(path)
    return spark.read.text(path)


def random_vector(spark: SparkSession, n: int, low: float, high: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.rand(seed) * (high - low) + low).alias("x"))
