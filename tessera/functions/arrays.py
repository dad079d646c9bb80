"""Dense arrays as rows: element-wise maps, products, convolutions, reductions, scans, histograms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import checkpointed


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, v) of a(row, k, v) times b(k, col, v); products are summed before the shuffle."""
    return a.toDF("row", "k", "x").join(b.toDF("k", "col", "y"), "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _tiles(m: DataFrame, tile: int, names: tuple[str, str]) -> DataFrame:
    """(names, t): dense tiles of m(row, col, v) as arrays of tile * tile values in row order."""
    row, col, v = m.columns
    at = F.struct(((F.col(row) % tile) * tile + F.col(col) % tile).cast("int").alias("p"), F.col(v).alias("x"))
    cells = m.groupBy(F.floor(F.col(row) / tile).alias(names[0]), F.floor(F.col(col) / tile).alias(names[1])).agg(F.map_from_entries(F.collect_list(at)).alias("m"))
    zero = F.lit(0).cast(m.schema[v].dataType)
    return cells.select(*names, F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda p: F.coalesce(F.col("m")[p], zero)).alias("t"))


def matmul_blocked(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """The same through square tiles: one row per tile, joined once per (i, k, j); tile products are summed by cell.

    Every element of a factor is shuffled once, and a product gives tile^2 rows rather than tile^3.
    """
    x, y = _tiles(a.toDF("row", "k", "x"), tile, ("i", "kk")), _tiles(b.toDF("k", "col", "y"), tile, ("kk", "j"))
    both = x.select("i", "kk", F.col("t").alias("s")).join(y, "kk")
    dot = lambda r, c: F.aggregate(F.sequence(F.lit(0), F.lit(tile - 1)), F.lit(0).cast("long"), lambda acc, k: acc + F.get("s", r * tile + k) * F.get("t", k * tile + c))
    cells = F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda p: dot(F.floor(p / tile).cast("int"), (p % tile).cast("int")))
    parts = both.select("i", "j", F.posexplode(cells).alias("p", "x")).groupBy("i", "j", "p").agg(F.sum("x").alias("v"))
    placed = parts.select((F.col("i") * tile + F.floor(F.col("p") / tile)).alias("row"), (F.col("j") * tile + F.col("p") % tile).alias("col"), "v")
    # padding of the border tiles goes
    return placed.join(a.toDF("row", "k", "x").select("row").distinct(), "row", "left_semi").join(b.toDF("k", "col", "y").select("col").distinct(), "col", "left_semi").select("row", "col", "v")


def convolve(cells: DataFrame, mask: dict[tuple[int, ...], int], axes: list[str], channel: str | None = None, strip: int = 512) -> DataFrame:
    """Correlation with a centred mask, zero padding, same size: (axes, p), for integer values v.

    ``mask`` maps offsets to weights, with the channel first if there is one. The grid is cut into tiles of
    ``strip`` cells a side; a cell goes to the tiles that its halo touches (one, but for the borders), and a
    task works on one tile at a time. Cells that are not there count as 0 and give no result; equal places add up.
    """
    first = 1 if channel else 0
    reach = [max(abs(k[first + i]) for k in mask) for i in range(len(axes))]
    rows = cells.select(*([F.col(channel).cast("long").alias("_c")] if channel else [F.lit(0).cast("long").alias("_c")]), *[F.col(a).cast("long").alias(f"_a{i}") for i, a in enumerate(axes)], F.col("v").cast("long").alias("_v"))
    for i, r in enumerate(reach):
        to = F.array_distinct(F.array(*[F.floor((F.col(f"_a{i}") + o) / strip) for o in (-r, 0, r)]))
        rows = rows.withColumn(f"_t{i}", F.explode(to))
    taps = [(k[0] if channel else 0, k[first:], w) for k, w in mask.items()]
    schema = ", ".join([f"{a} long" for a in axes] + ["p long"])

    def run(key, group):
        at = [group.column(f"_a{i}").to_numpy() - key[i].as_py() * strip for i in range(len(axes))]
        value, channels = group.column("_v").to_numpy(), group.column("_c").to_numpy()
        own = np.all([(x >= 0) & (x < strip) for x in at], axis=0)
        # the part of the tile that holds cells
        low = [int(x.min()) for x in at]
        shape = [int(x.max()) - l + 1 for x, l in zip(at, low)]
        inner = tuple(x - l for x, l in zip(at, low))
        there = np.zeros(shape, bool)
        there[tuple(x[own] for x in inner)] = True
        total = np.zeros(shape, np.int64)
        for c in {t[0] for t in taps}:
            grid = np.zeros([n + 2 * r for n, r in zip(shape, reach)], np.int64)
            some = channels == c
            np.add.at(grid, tuple(x[some] + r for x, r in zip(inner, reach)), value[some])
            for _, offsets, w in (t for t in taps if t[0] == c):
                total += w * grid[tuple(slice(r + o, r + o + n) for r, o, n in zip(reach, offsets, shape))]
        where = np.nonzero(there)
        columns = [pa.array(x + l + key[i].as_py() * strip) for i, (x, l) in enumerate(zip(where, low))]
        return pa.Table.from_arrays([*columns, pa.array(total[where])], names=[*axes, "p"])

    return rows.groupBy(*[f"_t{i}" for i in range(len(axes))]).applyInArrow(run, schema)


def scan(rows: DataFrame, key: str, value: str, exclusive: bool = False, total: bool = False) -> DataFrame:
    """(key, s): running sums in the order of a unique key, without a window over all rows.

    Range partitions are summed on their own; the few partition totals are scanned and added. With
    ``total``, an exclusive scan has one more row: the key after the last one, and the sum of all.
    """
    spark = rows.sparkSession
    dealt = rows.select(key, value).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
    placed = checkpointed(dealt.withColumn("_b", F.spark_partition_id()))
    frame = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = placed.groupBy("_b").agg(F.sum(value).alias("t"))  # a row for each partition
    starts = totals.select("_b", F.coalesce(F.sum("t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    sums = placed.withColumn("s1", F.coalesce(F.sum(value).over(frame), F.lit(0))).join(F.broadcast(starts), "_b").select(key, (F.col("s0") + F.col("s1")).alias("s"))
    if total:
        last = placed.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).cast(placed.schema[key].dataType).alias(key), F.coalesce(F.sum(value), F.lit(0)).cast(sums.schema["s"].dataType).alias("s"))
        sums = sums.union(last)
    return sums


def ranked(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank from 0 by ``order``, unique within ``groups`` (none: over all rows).

    Like ``scan``: rows are range-partitioned, ranked within a partition and moved on by what a group
    has in earlier partitions, so a group of any size is spread over many tasks.
    """
    dealt = rows.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *groups, *order)
    placed = checkpointed(dealt.withColumn("_b", F.spark_partition_id()))
    within = Window.partitionBy("_b", *groups).orderBy(*order)
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_b", *groups).agg(F.count(F.lit(1)).alias("_n"))  # a group has a row for each partition it lies in
    starts = counts.select("_b", *groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    at = placed.withColumn("_r", F.row_number().over(within) - 1)
    return at.join(starts, ["_b", *groups]).select(*rows.columns, (F.col("_s") + F.col("_r")).cast("long").alias(name))


def histogram(texts: DataFrame, column: str, bins: int = 128) -> DataFrame:
    """(bin, cnt) of the characters below ``bins`` (at most 128: single bytes of UTF-8), zeros included.

    Bytes are counted by Arrow batch, so the shuffle has ``bins`` counts a batch and no row for a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            offsets, data = batch.column(0).buffers()[1:]
            if data is None:
                continue
            ends = np.frombuffer(offsets, np.int32 if batch.column(0).type == pa.string() else np.int64)[batch.column(0).offset :][: batch.num_rows + 1]
            for at in range(int(ends[0]), int(ends[-1]), 1 << 24):
                total += np.bincount(np.frombuffer(data, np.uint8)[at : min(at + (1 << 24), int(ends[-1]))], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins, dtype=np.int32)), pa.array(total[:bins])], names=["bin", "n"])

    counts = texts.select(F.col(column)).where(F.col(column).isNotNull()).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return texts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def parse_int(text):
    """Integer with its base from the prefix: 0x hexadecimal, 0 octal, else decimal."""
    digits = F.regexp_replace(text, "^-", "")
    value = F.when(digits.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(digits, 3, 64), 16, 10)).when(digits.rlike("^0[0-7]+$"), F.conv(digits, 8, 10)).otherwise(digits).try_cast("long")
    return F.when(text.startswith("-"), -value).otherwise(value)
