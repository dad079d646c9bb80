"""Chat formatting: collapse cumulative snapshots of logged conversations, then render.

A conversation that is logged again after each turn appears as many rows groups, each a prefix of the
next. Every turn has a rolling hash of all turns up to it: the running sum of four 32-bit pieces of
SHA-256 over (position, role, text), which is 128 bits and can be summed in two levels. A
conversation whose last hash is also an inner prefix hash of another one is dropped by an anti-join;
of equal conversations the smallest conv_id stays. What remains is maximal and gets rendered.

Only DataFrame functions are used. Positions come from range partitions in turn order, and hashes and
texts are worked on by blocks of ``BLOCK`` positions, so a conversation of very many rows, whatever their turn
numbers, is split; it is rendered as several parts of one block each.

Edge cases: turns are ordered by (turn, role, text), nulls first; a null role or text is unlike an
empty one for the comparison and rendered as empty; rows with a null conv_id form one conversation;
repeated rows are separate turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, table, written

BLOCK = 512
SUMS = ["_s0", "_s1", "_s2", "_s3"]


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Written (conv_id, role, text, _b, _pos): 1-based position of each turn and its block.

    Rows are sorted in range partitions; a conversation that spans several adds up their counts.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = written(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("_i"), F.spark_partition_id().alias("_t")), "sorted-turns")
    sizes = sorted_rows.groupBy("conv_id", "_t").agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("_t").alias("_t2"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_o"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_t") == F.col("_t2"))
    placed = sorted_rows.join(starts, same).withColumn("_pos", F.col("_o") + F.col("_i") + 1)
    placed = written(placed.select("conv_id", "role", "text", F.floor((F.col("_pos") - 1) / block).alias("_b"), "_pos"), "turns")
    discard(sorted_rows)
    return placed


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``placed`` with the rolling hash of all turns up to each one."""
    tag = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    digest = F.sha2(F.concat_ws("|", F.col("_pos").cast("string"), tag(F.col("role")), tag(F.col("text"))), 256)
    rows = placed.withColumn("_d", digest)
    for i, s in enumerate(SUMS):
        rows = rows.withColumn(s, F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long"))
    up_to = Window.partitionBy("conv_id", "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "_b", "_pos", *[F.sum(s).over(up_to).alias(s) for s in SUMS])
    ends = rows.groupBy("conv_id", "_b").agg(F.max_by(F.struct(*SUMS), "_pos").alias("_e"))
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("conv_id").alias("_c"), F.col("_b").alias("_b2"), *[F.coalesce(F.sum(f"_e.{s}").over(before), F.lit(0)).alias(f"{s}o") for s in SUMS])
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_b2"))
    return rows.join(starts, same).select("conv_id", "_pos", *[(F.col(s) + F.col(f"{s}o")).alias(s) for s in SUMS])


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another one."""
    hashes = written(prefix_hashes(placed), "turn-hashes")
    key = ["_pos", *SUMS]
    last = hashes.groupBy("conv_id").agg(F.max_by(F.struct(*key), "_pos").alias("_k")).select("conv_id", "_k.*")
    kept = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    lengths = last.select(F.col("conv_id").alias("_c"), F.col("_pos").alias("_len"))
    inner = hashes.join(lengths, F.col("conv_id").eqNullSafe(F.col("_c"))).where("_pos < _len").select(*key).distinct()
    return kept.join(inner, key, "left_anti").select("conv_id", F.col("_pos").alias("n_turns"))


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, part, first_turn, n_turns, rendered) of the maximal conversations.

    ``n_turns`` is the whole conversation's; ``first_turn`` the position of the part's first turn.
    """
    placed = positions(turns, block)
    kept = maximal(placed).withColumnRenamed("conv_id", "_c")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "n_turns", "_b", "_pos", line.alias("_line"))
    parts = rows.groupBy("conv_id", "n_turns", "_b").agg(F.array_sort(F.collect_list(F.struct("_pos", "_line"))).alias("_l"))
    return parts.select("conv_id", (F.col("_b") + 1).alias("part"), (F.col("_b") * block + 1).alias("first_turn"), "n_turns", F.concat_ws("", F.col("_l._line")).alias("rendered"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
    coalesce(strlen(role) || ':' || role, '-') || '|' || coalesce(strlen(text) || ':' || text, '-') AS item
  FROM conversations
), h AS (
  SELECT conv_id, pos, sha256(string_agg(item, '|') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM t
), n AS (SELECT conv_id, max(pos) AS len FROM h GROUP BY conv_id),
last AS (SELECT h.conv_id, h.pos, h.k FROM h JOIN n ON h.conv_id = n.conv_id AND h.pos = n.len),
inner_keys AS (SELECT DISTINCT h.pos, h.k FROM h JOIN n ON h.conv_id = n.conv_id WHERE h.pos < n.len),
one AS (SELECT pos, k, min(conv_id) AS conv_id FROM last GROUP BY pos, k),
kept AS (SELECT conv_id, pos AS len FROM one WHERE NOT EXISTS (SELECT 1 FROM inner_keys i WHERE i.pos = one.pos AND i.k = one.k)),
b AS (
  SELECT t.conv_id, kept.len, CAST(floor((t.pos - 1) / {BLOCK}) AS BIGINT) AS b, t.pos, '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) AS line
  FROM t JOIN kept ON t.conv_id = kept.conv_id
)
SELECT conv_id, b + 1 AS part, CAST(min(pos) AS BIGINT) AS first_turn,
  CAST(len AS BIGINT) AS n_turns, string_agg(line, '' ORDER BY pos) AS rendered
FROM b GROUP BY conv_id, len, b
"""
