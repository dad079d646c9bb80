"""Exact Jaccard join of documents' 5-word shingle sets, by prefixes and a prefix tree.

1. Equal sets form one class; the document of the least doc_id, then text digest, stands for it.
2. Shingles have one global order: rare ones by hash, then the frequent ones by frequency. (Which count
   as frequent comes from counts over all documents; it moves work, never results.) Two sets of Jaccard
   similarity ``percent`` or more share a shingle among the first n - ceil(percent * n) + 1 of each.
3. These prefixes are dealt by shingle. Groups of up to ``CAP`` classes list their pairs that pass the
   length and position filters. Larger groups first compare all members with the group's least class;
   members that are still in different components afterwards are compared in blocks, those of the group's largest component
   only with the others. Both are exact: a pair is left out only when its two classes are already in one component.
4. Every set has a bitmap of ``SKETCH`` bits, or of its size rounded up to a power of two if that is
   more: the parity of the shingles that fall on each bit. Two bitmaps differ in no more bits than the
   sets differ in shingles, so pairs whose bitmaps differ in more than the threshold allows are dropped
   before any set is read.
5. The ordered sets of the candidates of one class are stored in a prefix tree (trie) and searched with the class's own set:
   overlaps along a shared path are counted once and a subtree is left as soon as its lengths cannot reach the needed overlap.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Shingles are 63-bit hashes.

Edge cases: a null text or one without words has an empty set, is linked with nothing and is its own
component; a text of fewer than five words is one shingle; repeated rows share a class and give a
row each; a null doc_id never names a component unless all its members are null; an empty table
gives no rows; extra columns are ignored. Documents are told apart by doc_id and text digest, so
different texts under one doc_id, or without one, are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checked, table, written
from tessera.llm.components import connected
from tessera.llm.trie import PrefixTree

SHINGLE = 5
PERCENT = 80
#: Classes of a shingle up to which their pairs are listed at once.
CAP = 48
#: Block length for larger groups.
BLOCK = 512
#: Frequent shingles: counted at least this often, and as many as this at most (8 bytes each, broadcast).
FREQUENT, MAX_FREQUENT = 64, 1 << 18
#: Shingles that are counted together before those that occur once are let go.
CHUNK = 2_000_000
SALTS = 16
#: Members of a group's largest component that meet a block of the others at a time; sets in one prefix tree, and their keys.
MAJOR = 4096
TREE_SETS, TREE_KEYS = 2048, 1 << 20
SKETCH = 1024
TOP = np.uint64(1 << 63)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)) >> 1], np.uint64)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = len(w) - SHINGLE + 1
    h = w[:n] * ODD[0]
    for i in range(1, SHINGLE):
        h += w[i : i + n] * ODD[i]
    h ^= h >> np.uint64(32)
    h *= ODD[1]
    h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(1))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles on each bit."""
    size = max(SKETCH, 1 << (len(s) - 1).bit_length() if len(s) else 1)
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap brought to a smaller size in bytes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def may_differ(nx, ny, percent: int):
    """The most shingles in which similar sets of these sizes differ."""
    return nx + ny - 2 * -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def text_key():
    return F.md5(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """Written rows: (doc_id, key, n, h1, h2, sketch) of each document, and (h1 = shingle, n = count) with frequent = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "h1", "h2", "frequent", "sketch", "key"]
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= 4
            values, counts = values[keep], counts[keep]
            held.clear()
            zero = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([zero, pa.array(counts.astype(np.int64)), pa.array(values.astype(np.int64)), zero, pa.array(np.ones(len(values), bool)), pa.nulls(len(values), pa.binary()), pa.nulls(len(values), pa.string())], names=names)

        size = 0
        for batch in batches:
            out = []
            for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = shingle_set(text.as_py())
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((doc_id, len(s), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), False, sketch(s), key))
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield from counted()
                    size = 0
            if out:
                kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if held:
            yield from counted()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    return written(rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, frequent boolean, sketch binary, key string"), "signatures")


def ordered(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set as sorted keys of the global order: 63-bit hash, or the top bit and the frequency rank."""
    values, ranks = frequent
    if len(values) == 0 or len(s) == 0:
        return s
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    hit = values[at] == s
    return np.sort(np.where(hit, TOP | ranks[at] << np.uint64(32), s))


def _same(doc_id: str, key: str):
    """Whether a row is the document of a side table's ``_tessera_id`` and ``_tessera_key``."""
    return F.col(doc_id).eqNullSafe(F.col("_tessera_id")) & (F.col(key) == F.col("_tessera_key"))


def repeated(own: DataFrame) -> DataFrame:
    """Documents of ``own`` (doc_id, key) with more than one row."""
    counts = own.groupBy(F.col("doc_id").alias("_tessera_id"), F.col("key").alias("_tessera_key")).agg(F.count(F.lit(1)).alias("n"))
    return checked(counts.where("n > 1").select("_tessera_id", "_tessera_key"))


def distinct_texts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(_id, _key, text), once for each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"), "text")
    again = repeated(own)
    if again.isEmpty():
        return d
    once = written(d.join(again, _same("_id", "_key"), "left_semi").dropDuplicates(["_id", "_key"]), "repeated-texts")
    return d.join(again, _same("_id", "_key"), "left_anti").union(once)


def _rep_sets(texts: DataFrame, reps: DataFrame, frequent, emit, schema: str) -> DataFrame:
    """Runs ``emit(keys, row)`` -> list of columns for every row of ``reps`` (cls, rep, key, to1, to2, to3).

    ``keys`` is the class's ordered set, worked out once for rows of a class that follow one another.
    """
    both = texts.join(reps, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_key") == F.col("key"))).select("cls", "to1", "to2", "to3", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys = None, None
        for batch in batches:
            parts: list[list] = []
            size = 0
            for cls, *to, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if cls != last:
                    last, keys = cls, ordered(shingle_set(text.as_py()), frequent.value)
                parts.append(emit(keys, (cls, *to)))
                size += len(keys)
                if size >= CHUNK // 4:
                    yield _batch(parts, schema)
                    parts, size = [], 0
            if parts:
                yield _batch(parts, schema)

    return both.mapInArrow(run, schema)


def to_bytes(keys: np.ndarray) -> bytes:
    """The top 48 bits of each key, big-endian, so that bytes sort like the sets."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(raw: pa.Buffer) -> np.ndarray:
    full = np.zeros((raw.size // 6, 8), np.uint8)
    full[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return full.view(">u8").ravel().astype(np.uint64)


def _batch(parts: list[list], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = []
    for c in zip(*parts):
        columns.append(pa.array([y for x in c for y in x]) if isinstance(c[0], list) else pa.array(np.concatenate(c)))
    return pa.RecordBatch.from_arrays(columns, names=names)


POSTING = "token long, salt int, cls long, n long, pos int"
CANDIDATE = "token long, x long, y long, n long, pos int"


def _pairs(n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of a group that pass the length and the position filter."""
    i, j = np.triu_indices(len(n), 1)
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    most = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
    keep = (100 * small >= percent * large) & ((100 + percent) * most >= percent * (n[i] + n[j]))
    return i[keep], j[keep]


def candidates(postings: DataFrame, percent: int, cap: int) -> DataFrame:
    """Written CANDIDATE rows: pairs (x, y), or with y null members of groups that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in CANDIDATE.split(", ")]
        rest: list[np.ndarray] | None = None  # rows of the last token of a batch
        spilled = None  # token whose rows go out one by one

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def groups(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, spilled
            token, salt, cls, n, pos = columns
            edges = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            ends = np.r_[edges[1:], len(token)]
            out: list[tuple] = []
            whole = len(edges) if last else len(edges) - 1
            for a, b in zip(edges[:whole][(ends - edges)[:whole] > 1], ends[:whole][(ends - edges)[:whole] > 1]):
                out += one(token[a], salt[a], cls[a:b], n[a:b], pos[a:b])
            for a in edges[:whole][((ends - edges)[:whole] == 1) & ((salt[edges[:whole]] > 0) | (token[edges[:whole]] == (spilled[0] if spilled else 0)))]:
                out += one(token[a], salt[a], cls[a : a + 1], n[a : a + 1], pos[a : a + 1])
            if not last:
                a = edges[-1]
                key = (token[a], salt[a])
                if len(token) - a > cap or salt[a] > 0 or spilled == key:  # out now; the group may go on
                    out += [(token[a], x, None, y, z) for x, y, z in zip(cls[a:].tolist(), n[a:].tolist(), pos[a:].tolist())]
                    spilled, rest = key, None
                else:
                    rest = [c[a:] for c in columns]
            if out:
                yield flush(out)

        def one(token, salt, cls, n, pos) -> list[tuple]:
            if salt > 0 or spilled == (token, salt) or len(cls) > cap:
                return [(token, x, None, y, z) for x, y, z in zip(cls.tolist(), n.tolist(), pos.tolist())]
            i, j = _pairs(n, pos, percent)
            return [(token, min(x, y), max(x, y), None, None) for x, y in zip(cls[i].tolist(), cls[j].tolist()) if x != y]

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(columns[0]) == 0:
                continue
            if rest is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(rest, columns)]
                rest = None
            yield from groups(columns, False)
        if rest is not None:
            yield from groups(rest, True)

    # by default as many partitions as spark.sql.shuffle.partitions
    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "cls")
    return written(dealt.mapInArrow(run, CANDIDATE), "candidates")


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Written pairs (x, y) that the bitmaps do not rule out."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            least = may_differ(nx, ny, percent)
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist())):
                size = min(len(a), len(b))
                keep[i] = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= least[i]
            yield batch.filter(pa.array(keep)).select(["x", "y"])

    return written(both.mapInArrow(run, "x long, y long"), "pairs")


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, frequent, percent: int) -> DataFrame:
    """Written links (a, b): the pairs (x, y) of classes whose sets are similar enough.

    Each pair's sets go to (x, salt), x first and then the ys in the order of their sets.
    """
    salted = pairs.select("x", "y", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("long").alias("salt"))
    own = salted.select("x", "salt").distinct().select(F.col("x").alias("cls"), F.col("x").alias("to1"), F.col("salt").alias("to2"), F.lit(0).cast("long").alias("to3"))
    other = salted.select(F.col("y").alias("cls"), F.col("x").alias("to1"), F.col("salt").alias("to2"), F.lit(1).cast("long").alias("to3"))
    wanted = reps.join(own.union(other), "cls").select("cls", "rep", "key", "to1", "to2", "to3")

    def sent(keys: np.ndarray, row: tuple) -> list:
        cls, x, salt, kind = row
        return [[x], [salt], [kind], [cls], [to_bytes(keys)]]

    dealt = _rep_sets(texts, wanted, frequent, sent, "x long, salt long, kind long, y long, keys binary").repartition("x", "salt").sortWithinPartitions("x", "salt", "kind", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, held, size = np.zeros(0, np.uint64), None, [], 0

        def searched() -> pa.RecordBatch:
            tree = PrefixTree([keys for _, keys in held])
            hits = [held[i][0] for i in tree.similar(own, percent)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x] * len(hits), pa.int64()), pa.array(hits, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cls, kind, y, raw in zip(batch.column("x").to_pylist(), batch.column("kind").to_pylist(), batch.column("y").to_pylist(), batch.column("keys")):
                keys = from_bytes(raw.as_buffer())
                if held and (kind == 0 or len(held) >= TREE_SETS or size >= TREE_KEYS):
                    yield searched()
                    size = 0
                if kind == 0:
                    own, x = keys, cls
                    continue
                held.append((y, keys))
                size += len(keys)
        if held:
            yield searched()

    return written(dealt.mapInArrow(run, "a long, b long"), "links")


def block_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (x, y) of different components within each shingle's members (token, x, n, pos, sketch, comp), by blocks.

    Pairs that the bitmaps rule out are not listed.
    """
    by_comp = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("c"), F.sum("c").alias("m"))
    # blocks 0.. hold the rows of all but the largest component, blocks -1, -2, .. those of the largest one
    sizes = sizes.select("token", "major", F.ceil((F.col("m") - F.col("c")) / block).cast("int").alias("nb"), F.ceil(F.col("c") / MAJOR).cast("int").alias("nk"))
    rows = members.join(sizes, "token").withColumn("large", F.col("comp") == F.col("major"))
    place = F.xxhash64("x")
    rows = rows.withColumn("own", F.when(F.col("large"), -1 - F.pmod(place, F.col("nk"))).otherwise(F.pmod(place, F.col("nb"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("large"), 0).otherwise(-F.col("nk")), F.col("nb") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "n", "pos", "sketch", "comp")

    def run(key, group):
        own, x, n, pos, comp = (group.column(c).to_numpy() for c in ("own", "x", "n", "pos", "comp"))
        a, b = _pairs(n, pos, percent)
        keep = (comp[a] != comp[b]) & ((own[a] != own[b]) | (key[1].as_py() == key[2].as_py())) & (x[a] != x[b])
        a, b = a[keep], b[keep]
        marks = np.stack([folded(s, SKETCH // 8) for s in group.column("sketch").to_pylist()])
        differ = np.zeros(len(a), np.int64)
        for w in range(marks.shape[1]):
            differ += np.bitwise_count(marks[a, w] ^ marks[b, w])
        near = differ <= may_differ(n[a], n[b], percent)
        a, b = x[a[near]], x[b[near]]
        return pa.table({"x": np.minimum(a, b), "y": np.maximum(a, b)})

    return rows.groupBy("token", "i", "j").applyInArrow(run, "x long, y long").distinct()


def similar_classes(docs: DataFrame, percent: int = PERCENT, cap: int = CAP, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signatures, classes (cls, rep, key, n, h1, h2) and (node, comp) of the linked classes."""
    spark = docs.sparkSession
    rows = signatures(docs)
    signed = rows.where("not frequent and n > 0")
    texts = distinct_texts(docs, signed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "key")).alias("first")
    classes = signed.groupBy("n", "h1", "h2", "sketch").agg(first).select("n", "h1", "h2", "sketch", "first.rep", "first.key")
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    reps = classes.select("cls", "rep", "key")
    once = reps.select("*", *[F.lit(None).cast("long").alias(f"to{i}") for i in (1, 2, 3)])
    counts = rows.where("frequent").groupBy("h1").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT)
    top = counts.orderBy(F.desc("c"), "h1").limit(MAX_FREQUENT).toArrow()  # bounded by MAX_FREQUENT
    values = top.column("h1").to_numpy().astype(np.uint64)
    ranks = np.arange(len(values), 0, -1).astype(np.uint64)  # the most frequent last
    by_value = np.argsort(values)
    frequent = spark.sparkContext.broadcast((values[by_value], ranks[by_value]))

    def posting(keys: np.ndarray, row: tuple) -> list[np.ndarray]:
        cls, k = row[0], prefix_length(len(keys), percent)
        token = keys[:k]
        salt = np.where(token & TOP > 0, 1 + (cls * 2654435761 >> 7) % SALTS, 0).astype(np.int32)
        return [token.view(np.int64), salt, np.full(k, cls, np.int64), np.full(k, len(keys), np.int64), np.arange(k, dtype=np.int32)]

    found = candidates(_rep_sets(texts, once, frequent, posting, POSTING), percent, cap)
    members = found.where("y is null").select("token", "x", "n", "pos")
    centres = members.groupBy("token").agg(F.min_by("x", "x").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = members.join(centres, "token").where("x <> c").select(F.col("c").alias("x"), F.col("x").alias("y"))
    tried = found.where("y is not null").select("x", "y").union(stars).distinct()
    pairs = sketched(tried, classes, percent)

    def apart(some: DataFrame) -> DataFrame:
        """The pairs whose classes are in different components so far."""
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        both = some.join(of("x"), "x", "left").join(of("y"), "y", "left")
        return both.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")

    def further(some: DataFrame) -> DataFrame:
        """The components with the links among more pairs."""
        left = written(apart(some), "pairs")
        if left.isEmpty():
            return comps
        links = verified(left, texts, reps, frequent, percent)
        return connected(comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links))

    # one pair for each class joins most groups; then only pairs across components remain to be compared
    near = pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    comps = connected(verified(near, texts, reps, frequent, percent))
    comps = further(pairs.join(near, ["x", "y"], "left_anti"))

    placed = members.join(comps.withColumnRenamed("node", "x"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    torn = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    # pairs of two components that meet in a torn group, less those that were compared before
    marked = placed.join(torn, "token").join(classes.select(F.col("cls").alias("x"), "sketch"), "x")
    rest = sketched(block_pairs(marked, percent, block).join(pairs, ["x", "y"], "left_anti"), classes, percent)
    comps = further(rest)
    return rows, classes, comps


def named(docs: DataFrame, percent: int = PERCENT, cap: int = CAP, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every document, and those with words with ``first``, the (rep, key) that names the component."""
    rows, classes, comps = similar_classes(docs, percent, cap, block)
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "key").alias("first")
    nodes = classes.join(comps, classes["cls"] == comps["node"], "left").select("n", "h1", "h2", first, F.coalesce("comp", "cls").alias("comp"))
    least = nodes.groupBy("comp").agg(F.min("first").alias("first"))
    firsts = nodes.drop("first").join(least, "comp").select("n", "h1", "h2", "first")
    own = rows.where("not frequent")
    linked = own.where("n > 0").join(firsts, ["n", "h1", "h2"]).select("doc_id", "key", "n", "first")
    return own.select("doc_id", "key", "n"), linked


def components(docs: DataFrame, percent: int = PERCENT, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    own, linked = named(docs, percent, cap, block)
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.rep").alias("component_id"))
    return linked.union(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, md5_number(x) AS h FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS x FROM d)
), k AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(CAST(h AS VARCHAR), ',' ORDER BY h)) AS cls FROM s GROUP BY r),
c AS MATERIALIZED (SELECT cls, min(r) AS r, min(n) AS n FROM k GROUP BY cls),
cs AS MATERIALIZED (SELECT c.r, s.h, c.n FROM c JOIN s ON s.r = c.r),
p AS MATERIALIZED (SELECT x.r AS a, y.r AS b, x.n AS na, y.n AS nb, count(*) AS m FROM cs x JOIN cs y ON x.h = y.h AND x.r < y.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * m >= {PERCENT} * (na + nb - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
least AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN c ON c.r = reach.b JOIN k ON k.cls = c.cls JOIN d ON d.r = k.r GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, CASE WHEN k.n IS NULL THEN d.doc_id ELSE least.component_id END AS component_id
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN c ON c.cls = k.cls LEFT JOIN least ON least.r = c.r
"""


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least doc_id, then text digest.

    Rows that repeat a doc_id and text count as one document. Texts without words are linked with nothing:
    those with a null doc_id all stay.
    """
    own, linked = named(docs)
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.rep")) & (F.col("key") == F.col("first.key")))
    gone = checked(linked.where(other).select(F.col("doc_id").alias("_tessera_id"), F.col("key").alias("_tessera_key")).distinct())
    same = _same("doc_id", "_tessera_k")
    kept = docs.withColumn("_tessera_k", text_key()).join(gone, same, "left_anti")
    again = repeated(own.where("n > 0 or doc_id is not null"))
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_tessera_k"]))
    return kept.drop("_tessera_k")
