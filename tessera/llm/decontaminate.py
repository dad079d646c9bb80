"""Benchmark decontamination with DataFrame functions only.

1. Every document is 5-word shingles (64-bit hashes of the normalised words). Shingles that also occur
   in an item place item-sized windows: one that starts where the item would, as the shingle's offset
   in the item tells, and one that starts at the shingle itself, if enough item shingles lie in it for
   the threshold. Moving a window on to its next such shingle never lowers its similarity, and windows
   that hold no more of them than the one before are left out, so the best window is among these.
2. Distinct windows and items get a 64-bit SimHash of their shingles, weighted by multiplicity.
3. Multi-index Hamming search: a fingerprint is four blocks of 16 bits. If two fingerprints differ in
   at most 23 bits, some block differs in at most 5, and then some value within 2 flips of the window's
   block lies within 3 flips of the item's. The sides list those values, and an equi-join finds all pairs
   within the radius. A window is compared with the items of the size it was placed for. An item lists 2,788 values,
   so neither list is sent to all tasks: windows' values that no item lists are sifted out, the others meet by a shuffle.
4. A pair counts when its exact weighted Jaccard similarity, sum of the smaller multiplicities over the
   sum of the larger ones, is at least ``threshold``.

Words are maximal runs of letters and digits, lower-cased. Texts of 1 to 4 words are one shingle of
all their words, so short items match only documents that consist of the same words.

Edge cases: null or empty texts have no shingles and match nothing; ties for the best window go to the
smallest start; repeated rows give one result row; rows with a null doc_id are searched and reported
with a null doc_id; empty tables give no rows; extra columns are ignored. Items are told apart by their texts: one with a null
item_id is reported with it, and different texts under one item_id are searched each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checked, sifted, table, written

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 23
#: Flips of a block that a window and an item list: together the most that the best block of a pair within RADIUS differs in.
WINDOW_FLIPS, ITEM_FLIPS = 2, 3
#: Distinct item shingles up to which they are broadcast (16 bytes each); beyond, the join shuffles.
MAX_BROADCAST_SHINGLES = 1 << 20


def words_of(text):
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def let(value, body):
    """``body`` of a value that is worked out once: as a lambda's argument the optimizer cannot copy it."""
    return F.transform(F.array(value), body)[0]


def shingles_of(words, n: int = SHINGLE):
    """Hashes of the n-word windows, in order; of all words if there are fewer."""

    def hashed(w):
        size = F.size(w)
        whole = F.when(size > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(size < n, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))

    return let(words, hashed)


def sized_shingles(text):
    """Struct of n, the number of words, and s, the shingles."""
    return let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), shingles_of(w).alias("s")))


def simhashes(rows: DataFrame, key: str, shingles: str) -> DataFrame:
    """(key, fp): 64-bit SimHash of an array of hashes, repeats counting as often as they occur."""
    hashed = rows.select(key, F.explode(shingles).alias("_h"))
    bit = lambda i: F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{i}")
    sums = hashed.groupBy(key).agg(*[bit(i) for i in range(BLOCKS * BLOCK_BITS)])
    fp = F.lit(0).cast("bigint")
    for i in range(BLOCKS * BLOCK_BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"_b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return sums.select(key, fp.alias("fp"))


def near_blocks(fps: DataFrame, flips: int) -> DataFrame:
    """``fps`` with (block, value): for each block of fp, all values within so many flips."""
    near = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)]
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright("fp", b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)])
    rows = fps.select("*", F.explode(blocks).alias("_k")).withColumn("_f", F.explode(F.array(*map(F.lit, near))))
    return rows.select(*fps.columns, F.col("_k.block").alias("block"), F.col("_k.value").bitwiseXOR(F.col("_f")).alias("value"))


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(wkey, ikey): windows (wkey, size, fp) and items (ikey, size, fp) of one size within the radius.

    Spark takes the listed values to be as small as the written fingerprints, and would broadcast them unasked.
    """
    a, b = near_blocks(windows, WINDOW_FLIPS), near_blocks(items, ITEM_FLIPS).withColumnRenamed("fp", "ifp")
    by = ["size", "block", "value"]
    met = sifted(a, by, b, by).join(b.hint("merge"), by)
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("wkey", "ikey").distinct()


def bags(rows: DataFrame, key: str, shingles: str) -> DataFrame:
    return rows.select(key, F.explode(shingles).alias("_h")).groupBy(key, "_h").agg(F.count(F.lit(1)).alias("_n"))


def dense_starts(hits: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, key, size, start, len): windows from an item shingle on that hold enough of them.

    Two events a shingle position p, in order: p comes into reach of a window, then a window starts at p.
    Their running sum is the number of item shingles in the window. Tasks stream over a document's events.
    """
    reach = F.col("size") - SHINGLE
    events = F.array(F.struct((F.col("p") - reach).alias("pos"), F.lit(0).alias("starts")), F.struct(F.col("p").alias("pos"), F.lit(1).alias("starts")))
    places = hits.where(F.col("size") >= SHINGLE).select("doc_id", "key", "n", "size", "p").distinct()
    rows = places.select("doc_id", "key", "n", "size", F.explode(events).alias("e")).select("doc_id", "key", "n", "size", "e.*")
    by = Window.partitionBy("doc_id", "key", "size").orderBy("pos", "starts")
    seen = F.sum(1 - 2 * F.col("starts")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    rows = rows.withColumn("held", seen).withColumn("before", F.lag("starts", 1, 0).over(by)).where("starts = 1")
    words = F.least(F.col("size"), F.col("n") - F.col("pos"))
    needed = threshold / (1 + threshold) * (words + F.col("size") - 2 * (SHINGLE - 1)) - 1e-6
    whole = F.col("pos") + F.col("size") <= F.col("n")
    return rows.where((F.col("held") >= needed) & ~(whole & (F.col("before") == 1))).select("doc_id", "key", "size", F.col("pos").alias("start"), words.alias("len"))


def passages(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, item_id, start, len, similarity): the matching windows; key is the text's digest."""
    keyed_items = items.select("item_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("ikey"), "text")
    own = keyed_items.dropDuplicates(["ikey"]).select("ikey", sized_shingles(F.col("text")).alias("x")).select("ikey", F.col("x.n").alias("size"), "x.s").where("size > 0")
    own = written(own, "items")
    posted = own.select("size", F.posexplode("s").alias("j", "h")).distinct()
    n = posted.count()

    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    shingled = keyed.select("doc_id", "key", F.explode(F.array(sized_shingles(F.col("text")))).alias("x"))
    at = shingled.select("doc_id", "key", F.col("x.n").alias("n"), F.posexplode("x.s").alias("p", "h"))
    hits = at.join(F.broadcast(posted) if n <= MAX_BROADCAST_SHINGLES else posted, "h").where(f"(n < {SHINGLE}) = (size < {SHINGLE})")
    hits = written(hits.select("doc_id", "key", "n", "p", "j", "size"), "hits")
    start = F.greatest(F.col("p") - F.col("j"), F.lit(0))
    end = F.least(F.col("p") - F.col("j") + F.col("size"), F.col("n"))
    placed = hits.select("doc_id", "key", "size", start.alias("start"), (end - start).alias("len")).union(dense_starts(hits, threshold)).distinct()
    per_doc = placed.groupBy("doc_id", "key").agg(F.collect_set(F.struct("size", "start", "len")).alias("at"))

    d, p = keyed.alias("d"), per_doc.alias("p")
    found = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key"))).select("d.doc_id", "d.key", "d.text", "p.at")
    cut = let(words_of(F.col("text")), lambda w: F.transform("at", lambda a: F.struct(a["size"].alias("size"), a["start"].alias("start"), a["len"].alias("len"), F.slice(w, a["start"] + 1, a["len"]).alias("w"))))
    spans = found.select("doc_id", "key", F.explode(cut).alias("a")).select("doc_id", "key", "a.*")
    windows = written(spans.select("doc_id", "key", "size", "start", "len", F.md5(F.array_join("w", " ")).alias("wkey"), shingles_of(F.col("w")).alias("s")).distinct(), "windows")
    distinct = windows.select("wkey", "s").dropDuplicates(["wkey"])

    sized_fps = written(simhashes(distinct, "wkey", "s").join(windows.select("wkey", "size").distinct(), "wkey"), "window-simhashes")
    item_fps = written(simhashes(own, "ikey", "s").join(own.select("ikey", "size"), "ikey"), "item-simhashes")
    pairs = near_pairs(sized_fps, item_fps)

    wb, ib = bags(distinct, "wkey", "s"), bags(own, "ikey", "s").withColumnRenamed("_n", "_m")
    shared = pairs.join(wb, "wkey").join(ib, ["ikey", "_h"]).groupBy("wkey", "ikey").agg(F.sum(F.least("_n", "_m")).alias("inter"))
    sized = shared.join(distinct.select("wkey", F.size("s").alias("_ws")), "wkey").join(own.select("ikey", "size", F.size("s").alias("_is")), "ikey")
    similarity = F.col("inter") / (F.col("_ws") + F.col("_is") - F.col("inter"))
    matches = sized.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("wkey", "size", "ikey", "similarity")
    matches = matches.join(keyed_items.select("ikey", "item_id").distinct(), "ikey").drop("ikey")

    return windows.select("doc_id", "key", "size", "start", "len", "wkey").join(matches, ["wkey", "size"]).drop("wkey", "size")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each matching pair."""
    rows = passages(docs, items, threshold)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "len")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.start")).cast("long").alias("first_word"), F.col("m.len").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark passage; another text under the same doc_id is another document."""
    hit = checked(passages(docs, items).select(F.col("doc_id").alias("_tessera_id"), F.col("key").alias("_tessera_key")).distinct())
    keyed = docs.withColumn("_tessera_k", F.md5(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_tessera_id")) & (F.col("_tessera_k") == F.col("_tessera_key"))
    return keyed.join(hit, same, "left_anti").drop("_tessera_k")
