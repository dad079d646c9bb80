"""Removal of long byte strings that occur more than once, by column-wise construction of a collection's suffix order.

The column-wise method inserts one symbol of every document per round, from the last column to the
first. Each round's order follows from the last one by a stable sort on the new symbols, as in the
Burrows-Wheeler transform, and the common prefixes of neighbours follow from range minima. Over whole
documents that takes as many rounds as the longest document has bytes, each over the whole corpus, so
it is run where a repeat is possible, on aligned excerpts, which bounds the rounds:

1. Anchors. Of every ``length`` consecutive bytes, the first k-gram of least hash is an anchor
   (winnowing), so equal strings of that length hold the same anchor at the same place. Anchors whose
   hash occurs once cannot lie in a repeated string and are let go, but for the few that the filter of
   the others, which all tasks hold, does not tell from them.
2. Excerpts. An anchor stands for the strings of ``length`` bytes whose first least k-gram it is; their
   starts are a range. Excerpts hold just these strings. Those of one anchor hash form a
   collection, aligned at the anchor; every string lies in one collection only.
3. Columns. The collection's columns are inserted from right to left, with the order and the common
   prefixes kept as above. In a column at or left of the anchor, an excerpt with a neighbour that shares
   ``length`` bytes starts a repeated string. An excerpt leaves the collection once nothing
   that holds the anchor is shared with a neighbour.
4. Covered bytes are the union of these strings.

Texts that occur as several rows are fully repeated when they have ``length`` bytes; one of the rows
stands for them in the collections. Collections of more than ``MAX_GROUP`` excerpts are split by content
down to single strings, known by a 128-bit digest and counted by an aggregate, so no task holds an
unbounded collection. Tasks stream: sorted shuffle files are
read in sequence, and a task holds ``BATCH`` excerpts or one collection.

The symbols are bytes, or words by a 32-bit hash (``WORDS``): ``passages`` finds runs of more than 50
words that also occur in another document. Anchors of both are found in one pass, and texts that hold a
repeated one of either are shuffled once.

Edge cases: null and empty texts have no bytes; a string that overlaps its own copy counts; matches
never cross rows; repeated rows are different documents; null doc_ids are rows like others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checked, discard, sifted, table, written

LENGTH = 400
GRAM = 32
#: Excerpts of small collections that are worked on together, and the largest collection in one task.
BATCH, MAX_GROUP = 8_000, 50_000
#: Symbols that are hashed, and bytes of texts that are worked on, at a time.
BLOCK, TEXTS = 1 << 19, 1 << 21
#: Bits, a power of two, of the largest filter by which repeated anchors are told from others, 64 MB that go to all tasks, and bits set for an anchor.
MOST_BITS, HASHES = 1 << 29, 4
#: Parts of the rows of one string in the join that marks repeated strings.
SALTS = 32


ODD = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(0).integers(1, 1 << 63, 256, np.uint64)


@dataclass(frozen=True)
class Symbols:
    """What is compared: strings of ``length`` symbols of ``step`` bytes, by anchors of ``gram`` symbols.

    With ``across``, only strings that different texts hold count as repeated.
    """

    step: int
    length: int
    gram: int
    across: bool = False

    def of(self, text: pa.StringScalar) -> np.ndarray:
        """The symbols of a text as bytes."""
        data = np.frombuffer(text.as_buffer(), np.uint8)
        return self.of_all(data, np.array([0, len(data)]))[0]

    def of_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols, as bytes, of texts that lie end to end in ``data``, and the texts' bounds among them."""
        if self.step == 1:
            return data, bounds
        starts = word_starts(data, bounds)
        return word_hashes(data, starts).view(np.uint8), np.searchsorted(starts, bounds)


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a word begins: after white space or at the start of a text."""
    begins = np.r_[True, is_space(data[:-1])] if len(data) else np.zeros(0, bool)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(begins & ~is_space(data))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32-bit hashes of the words that begin at ``starts`` and end at white space or the next start."""
    if not len(starts):
        return np.zeros(0, "<u4")
    own = data[starts[0] :]
    sizes = np.diff(np.r_[starts, len(data)])
    place = np.arange(len(own)) - np.repeat(starts - starts[0], sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), ODD, np.uint64))
    value = BYTES[own] * powers[place]
    value[is_space(own)] = 0
    h = np.add.reduceat(value, starts - starts[0])
    h ^= h >> np.uint64(31)
    h *= ODD
    return (h >> np.uint64(32)).astype("<u4")


WORDS = Symbols(step=4, length=51, gram=8, across=True)

EXCERPT = "anchor long, cls string, pos int, left int, bytes binary"
COVER = "cls string, s long, e long"


def grams(data: np.ndarray, gram: int, step: int = 1) -> np.ndarray:
    """63-bit hashes of the k-grams of a symbol array; ``gram`` symbols are a multiple of 8 bytes."""
    n = len(data) // step - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    h = np.zeros(n, np.uint64)
    for i in range(0, gram * step, 8):
        h ^= words[i : i + (n - 1) * step + 1 : step]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
    return h >> np.uint64(1)


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, symbols: Symbols) -> list[np.ndarray]:
    """[text, hash, position, first, last] of the anchors of texts that lie end to end.

    ``data`` holds their symbols, ``bounds`` where each begins and the end; first and last start of the strings that
    an anchor stands for, like its position, count from the start of its text.
    """
    step, length = symbols.step, symbols.length
    width = length - symbols.gram + 1  # k-grams in a string
    found = [[np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]]
    for at in range(0, max(0, int(bounds[-1]) - length + 1), BLOCK):
        h = grams(data[at * step : (at + BLOCK + length - 1) * step], symbols.gram, step)
        mixed = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        least = sliding_minimum(mixed, width)
        start = np.arange(at, at + len(least))
        text = np.searchsorted(bounds, start, "right") - 1
        whole = start + length <= bounds[text + 1]  # strings that end in their text
        new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(whole & (new | ~np.r_[False, whole[:-1]]))
        last = np.flatnonzero(whole & (np.r_[new[1:], True] | ~np.r_[whole[1:], False]))
        pos = (least[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        base = at - bounds[text[first]]
        found.append([text[first], h[pos], pos + base, first + base, last + base])
    return [np.concatenate(c) for c in zip(*found)]


PLACE = pa.struct([("anchor", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
PLACES = "array<struct<anchor:long,pos:int,first:int,last:int>>"
MARKED = pa.struct([*PLACE, ("large", pa.bool_())])


def all_anchors(keyed: DataFrame, kinds: list[Symbols]) -> DataFrame:
    """Written rows of all documents that have an anchor: cls, doc_id, and for each of ``kinds`` n_0, .. symbols and at_0, .. places.

    ``TEXTS`` bytes of texts are worked on at a time.
    """
    names = ["cls", "doc_id", *[f"{c}_{i}" for i in range(len(kinds)) for c in ("n", "at")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + TEXTS, "right")) - 1)
                columns, some = [batch.column(c).slice(a, b - a) for c in ("cls", "doc_id")], np.zeros(b - a, bool)
                for symbols in kinds:
                    data, bounds = symbols.of_all(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    text, h, *rest = anchors(data, bounds, symbols)
                    edges = np.searchsorted(text, np.arange(b - a + 1))
                    some |= np.diff(edges) > 0
                    place = pa.StructArray.from_arrays([pa.array(h.astype(np.int64)), *[pa.array(c.astype(np.int32)) for c in rest]], fields=list(PLACE))
                    columns += [pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), place)]
                if some.any():
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(some))
                a = b

    kind = ", ".join(["cls string, doc_id long", *[f"n_{i} long, at_{i} {PLACES}" for i in range(len(kinds))]])
    return written(keyed.select("cls", "doc_id", "text").mapInArrow(run, kind), "anchors")


def bits_of(anchors: DataFrame) -> np.ndarray:
    """A Bloom filter of ``anchors``, packed: 24 bits or more for each of them, but at most ``MOST_BITS``."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(20, (24 * anchors.count()).bit_length()))
    low, high = F.col("anchor").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright("anchor", 31)
    spots = anchors.select(F.explode(F.array(*[(low + i * high).bitwiseAND(F.lit(size - 1)) + 1 for i in range(HASHES)])).alias("_k"))
    bits = np.zeros(size // 8, np.uint8)
    for r in spots.groupBy(F.bitmap_bucket_number("_k").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_k")).alias("bits")).collect():
        bits[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def holds(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which of these anchors a filter of ``bits_of`` holds: all that it was made of, and few others."""
    low, high, out = anchor & ((1 << 31) - 1), anchor >> 31, np.ones(len(anchor), bool)
    for i in range(HASHES):
        spot = (low + i * high) & (8 * len(bits) - 1)
        out &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
    return out


def marked(found: DataFrame, marks: Broadcast) -> DataFrame:
    """Rows of ``all_anchors`` with the places only whose anchor a filter holds, and whether its collection is large.

    ``marks`` holds for each kind the filter of repeated anchors and, sorted, the anchors of large collections. The few
    others that a filter holds stay too; their collections repeat nothing.
    """
    names = ["cls", "doc_id", *[c for c in found.columns if c.startswith("at_")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, some = [batch.column(c) for c in names[:2]], np.zeros(batch.num_rows, bool)
            for c, (bits, large) in zip(names[2:], marks.value):
                edges = batch.column(c).offsets.to_numpy()
                parts = batch.column(c).values.slice(edges[0], edges[-1] - edges[0]).flatten()
                anchor = parts[0].to_numpy()
                keep = holds(bits, anchor)
                edges = np.r_[0, np.cumsum(keep)][edges - edges[0]]
                some |= np.diff(edges) > 0
                parts = [x.filter(pa.array(keep)) for x in parts]
                place = pa.StructArray.from_arrays([*parts, pa.array(np.isin(anchor[keep], large))], fields=list(MARKED))
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), place))
            if some.any():
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(some))

    kind = ", ".join(["cls string, doc_id long", *[f"{c} {PLACES[:-2]},large:boolean>>" for c in names[2:]]])
    return found.select(names).mapInArrow(run, kind)


def excerpts(reps: DataFrame, symbols: Symbols) -> DataFrame:
    """EXCERPT rows of (cls, text, at: array of (anchor, pos, first, last, ..))."""
    names = [x.split()[0] for x in EXCERPT.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = batch.column("at").offsets.to_numpy()
            places = batch.column("at").values.slice(edges[0], edges[-1] - edges[0])
            anchor, pos, first, last = (places.field(c).to_numpy() for c in ("anchor", "pos", "first", "last"))
            starts, ends = (first * symbols.step).tolist(), ((last + symbols.length) * symbols.step).tolist()
            edges = (edges - edges[0]).tolist()
            parts: list[bytes] = []
            own: list[int] = []
            for i, text in enumerate(batch.column("text")):
                data = symbols.of(text).tobytes()
                parts += [data[a:b] for a, b in zip(starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]])]
                own += [i] * (edges[i + 1] - edges[i])
                if parts and (len(parts) >= 5000 or i + 1 == batch.num_rows):
                    at = slice(edges[i + 1] - len(parts), edges[i + 1])
                    columns = anchor[at], batch.column("cls").take(pa.array(own)), pos[at], pos[at] - first[at], parts
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names=names)
                    parts, own = [], []

    return reps.where(F.size("at") > 0).select("cls", "text", "at").mapInArrow(run, EXCERPT)


def repeated_starts(group: np.ndarray, left: np.ndarray, data: list[bytes], length: int = LENGTH, step: int = 1, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(excerpt, offset from its anchor) of all strings of ``length`` symbols that occur twice in a group.

    ``data[i]`` has ``left[i]`` symbols before the anchor. Two places of a group count as different even if
    their bytes belong to the same text, unless ``owner`` says whose they are.
    """
    sizes = np.array([len(x) // step for x in data], np.int64)
    wide_left, wide_right = int(left.max()), int((sizes - left).max())
    flat = np.frombuffer(b"".join(data), np.uint8)
    if step > 1:
        flat = np.unique(flat.view("<u4"), return_inverse=True)[1].astype(np.int32)
    wide = max(9, int(flat.max()).bit_length() + 1)  # bits of a symbol
    columns = np.full((wide_left + wide_right, len(data)), -1, np.int16 if step == 1 else np.int32)  # -1: no symbol
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        a = wide_left - left[i]
        columns[a : a + size, i] = flat[end - size : end]
    found_at, found_of = [], []
    order = np.argsort(group, kind="stable")  # order of the suffixes that start at the current column
    prefix = np.zeros(len(order), np.int32)  # common with the one before, in the same group
    ranks = np.arange(len(order), dtype=np.int64)
    bits = max(1, int(len(order)).bit_length())
    gid = np.unique(group, return_inverse=True)[1].astype(np.int64)
    for column in range(wide_left + wide_right - 1, -1, -1):
        symbol = columns[column][order].astype(np.int64)
        key = (((gid[order] << wide) | (symbol + 1)) << bits) | ranks[: len(order)]
        key.sort()
        came = key & ((1 << bits) - 1)  # place in the former order
        value = key >> bits
        same = np.r_[False, value[1:] == value[:-1]] & (value & ((1 << wide) - 1) > 0)
        new = np.zeros(len(order), np.int32)
        here = np.flatnonzero(same)
        if len(here):
            a, b = came[here - 1] + 1, came[here] + 1  # least prefix over former places a..b-1
            near = b == a + 1
            least = prefix[a].copy()
            far = np.flatnonzero(~near)
            if len(far):
                bounds = np.empty(2 * len(far), np.int64)
                bounds[0::2], bounds[1::2] = a[far], b[far]
                least[far] = np.minimum.reduceat(np.append(prefix, np.int32(1 << 30)), bounds)[0::2]
            new[here] = least + 1
        order, prefix = order[came], new
        if column <= wide_left:
            most = np.maximum(prefix, np.r_[prefix[1:], 0])
            hit = order[most >= length]
            if len(hit) and owner is not None:
                edges = np.flatnonzero(prefix < length)  # equal strings stand together from one to the next
                whose = owner[order]
                several = np.minimum.reduceat(whose, edges) != np.maximum.reduceat(whose, edges)
                hit = order[np.repeat(several, np.diff(np.r_[edges, len(order)]))]
            if len(hit):
                found_of.append(hit)
                found_at.append(np.full(len(hit), column - wide_left))
            alive = most > wide_left - column  # else nothing that holds the anchor is shared any more
            if not alive.all():
                order, prefix = shrink(order, prefix, alive)
                if not len(order):
                    break
    if not found_of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_of), np.concatenate(found_at)


def shrink(order: np.ndarray, prefix: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave out suffixes; a prefix becomes the least one over those left out before it."""
    kept = np.flatnonzero(alive)
    if not len(kept):
        return order[:0], prefix[:0]
    return order[kept], np.minimum.reduceat(prefix[: kept[-1] + 1], np.r_[0, kept[:-1] + 1]).astype(np.int32)


def repeated(rows: DataFrame, symbols: Symbols, batch_size: int) -> DataFrame:
    """COVER rows: runs of repeated strings in collections that lie together in sorted partitions."""

    def work(anchor: np.ndarray, cls: list[str], pos: np.ndarray, left: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        own = np.flatnonzero(several)
        if len(own):
            whose = np.unique([cls[i] for i in own], return_inverse=True)[1] if symbols.across else None
            of, at = repeated_starts(anchor[own], left[own], [data[i] for i in own], symbols.length, symbols.step, whose)
            by = np.lexsort((at, of))
            of, at = own[of[by]], at[by]
            if len(of):  # neighbouring starts of an excerpt make one run
                new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])
                last = np.r_[new[1:], len(of)] - 1
                first = pos[of[new]]
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in of[new].tolist()], pa.string()), pa.array(first + at[new]), pa.array(first + at[last] + symbols.length)], names=["cls", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emptied(keep_last: bool) -> Iterator[pa.RecordBatch]:
            """Work on what is held, but for the last collection if it may go on."""
            whole = pa.Table.from_batches(held)
            anchor = whole.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if keep_last else len(anchor)
            if cut:
                part = whole.slice(0, cut)
                yield from work(anchor[:cut], part.column("cls").to_pylist(), part.column("pos").to_numpy().astype(np.int64), part.column("left").to_numpy().astype(np.int64), part.column("bytes").to_pylist())
            held[:] = whole.slice(cut).combine_chunks().to_batches()

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                held.append(batch.slice(at, batch_size))
                size += held[-1].num_rows
                if size >= batch_size:
                    yield from emptied(True)
                    size = 0
        if held:
            yield from emptied(False)

    return rows.mapInArrow(run, COVER)


def counted(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """The same for collections too large for a task: every string is a collection of its own, known by a 128-bit digest.

    The rows of one string are spread over ``SALTS`` parts when they are marked.
    """
    step, length = symbols.step, symbols.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                n = len(x["bytes"]) // step - length + 1
                keys = [hashlib.blake2b(x["bytes"][i * step : (i + length) * step], digest_size=16).digest() for i in range(n)]
                first = x["pos"] - x["left"]
                yield pa.RecordBatch.from_arrays([pa.array([x["cls"]] * n, pa.string()), pa.array(range(first, first + n), pa.int32()), pa.array(keys, pa.binary())], names=["cls", "start", "h"])

    strings = rows.mapInArrow(run, "cls string, start int, h binary")
    whose = F.xxhash64("cls")
    seen = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(whose).alias("lo"), F.max(whose).alias("hi"))
    twice = seen.where("lo <> hi" if symbols.across else "n > 1").select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = strings.withColumn("salt", F.pmod(F.xxhash64("cls", "start"), F.lit(SALTS)).cast("int"))
    return salted.join(twice, ["h", "salt"], "left_semi").select("cls", F.col("start").cast("long").alias("s"), (F.col("start") + length).cast("long").alias("e"))


def merge(runs: list[dict]) -> list[dict]:
    """The union of runs (s, e), as maximal runs in order."""
    out: list[dict] = []
    for x in sorted(runs, key=lambda r: (r["s"], r["e"])):
        if out and x["s"] <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], x["e"])
        else:
            out.append(dict(x))
    return out


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, cls) and, written, the classes of equal texts: cls, rep, copies, n_bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("cls"))
    classes = keyed.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.max(F.octet_length("text")).cast("long").alias("n_bytes"))
    return keyed, written(classes, "text-classes")


@dataclass(frozen=True)
class Repeats:
    """Written tables: ``runs``, for each kind of symbols (cls, runs), the maximal runs (s, e) of symbols in repeated strings
    of the classes that have any; ``sizes``, (cls, n_0, ..) of the classes with anchors; ``reps``, (cls, text) of the classes in ``runs`` and more.
    """

    runs: list[DataFrame]
    sizes: DataFrame
    reps: DataFrame


def repeats(keyed: DataFrame, kinds: list[Symbols], batch_size: int = BATCH, max_group: int = MAX_GROUP) -> Repeats:
    """What repeats by each of ``kinds``: texts are read twice and shuffled once, those with a repeated anchor only."""
    found = all_anchors(keyed.where(F.octet_length("text") >= min(x.length for x in kinds)), kinds)
    marks = [repeated_anchors(found, i, symbols, max_group) for i, symbols in enumerate(kinds)]
    held = keyed.sparkSession.sparkContext.broadcast(marks)
    at = [f"at_{i}" for i in range(len(kinds))]
    # copies have equal places, so these are the classes' representatives
    wanted = written(marked(found, held).groupBy("cls").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in at]), "wanted")
    held.destroy()
    sizes = written(found.select("cls", *[f"n_{i}" for i in range(len(kinds))]).dropDuplicates(["cls"]), "sizes")
    discard(found)
    k, w = sifted(keyed, ["cls", "doc_id"], wanted, ["cls", "rep"]).alias("k"), wanted.alias("w")
    same = (F.col("k.cls") == F.col("w.cls")) & F.col("k.doc_id").eqNullSafe(F.col("w.rep"))
    reps = written(k.join(w, same).select("k.cls", "k.text", *at), "wanted-texts")
    discard(wanted)
    runs = [repeated_runs(reps.select("cls", "text", F.col(f"at_{i}").alias("at")), symbols, bool(len(marks[i][1])), batch_size) for i, symbols in enumerate(kinds)]
    return Repeats(runs, sizes, reps)


def repeated_anchors(found: DataFrame, kind: int, symbols: Symbols, max_group: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all anchors that may lie in a repeated string, and the sorted anchors of more than ``max_group`` places."""
    places = found.select("cls", F.explode(f"at_{kind}").alias("x")).select("cls", "x.anchor", "x.pos")
    # an anchor of one place is no repeat, however many copies of its text there are; n counts the copies too
    whose = F.xxhash64("cls")
    shared = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(whose).alias("lo"), F.max(whose).alias("hi"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    shared = shared.withColumn("twice", F.expr("lo <> hi" if symbols.across else "lo <> hi or p0 <> p1")).select("anchor", "n", "twice")
    shared = written(shared.where(F.col("twice") | (F.col("n") > max_group)), "repeated-anchors")
    several = shared.where(F.col("n") > max_group).select("anchor")
    large: list[int] = []
    if not several.isEmpty():  # then the copies are told from the places
        one_place = places.join(checked(several), "anchor", "left_semi").distinct()
        large = [r["anchor"] for r in one_place.groupBy("anchor").count().where(F.col("count") > max_group).collect()]  # at most a max_group-th of the places
    bits = bits_of(shared.where("twice").select("anchor"))
    discard(shared)
    return bits, np.sort(np.array(large, np.int64))


def repeated_runs(reps: DataFrame, symbols: Symbols, crowded: bool, batch_size: int) -> DataFrame:
    """Written (cls, runs) of rows (cls, text, at); with ``crowded``, some collections are large."""
    of = lambda large: reps.withColumn("at", F.filter("at", lambda x: x["large"] == large)) if crowded else reps
    starts = repeated(excerpts(of(False), symbols).repartition("anchor").sortWithinPartitions("anchor"), symbols, batch_size)
    if crowded:
        starts = starts.union(counted(written(excerpts(of(True), symbols), "large-excerpts"), symbols))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            out = [merge(x) for x in batch.column("some").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(out, kind)], names=["cls", "runs"])

    starts = written(starts, "covered")
    per_class = starts.groupBy("cls").agg(F.collect_set(F.struct("s", "e")).alias("some")).mapInArrow(runs, "cls string, runs array<struct<s:long,e:long>>")
    per_class = written(per_class, "runs")
    discard(starts)
    return per_class


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_size: int = BATCH, max_group: int = MAX_GROUP) -> DataFrame:
    """Per class of equal texts: cls, copies, n_bytes, and runs, the array of (start, end) to remove."""
    keyed, classes = _texts(docs)
    return removed(classes, repeats(keyed, [Symbols(1, length, gram)], batch_size, max_group).runs[0], length)


def removed(classes: DataFrame, per_class: DataFrame, length: int = LENGTH) -> DataFrame:
    """``removals`` from the runs of repeated strings."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    runs_of = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), whole).otherwise(F.coalesce("runs", none))
    return classes.join(per_class, "cls", "left").select("cls", "rep", "copies", "n_bytes", runs_of.alias("runs"))


def passages(classes: DataFrame, found: Repeats, kind: int, symbols: Symbols = WORDS) -> DataFrame:
    """Per class of equal texts that holds any: cls, and n_passage_words, the words in passages of ``symbols.length`` or more words that another document holds too.

    Words are what stands between white space. All words of a text of that length with an exact copy count.
    """
    whole = found.sizes.select("cls", F.col(f"n_{kind}").alias("n")).where(F.col("n") >= symbols.length).join(classes.where("copies > 1").select("cls"), "cls")
    parts = found.runs[kind].select("cls", F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"]).alias("n"))
    return whole.union(parts).groupBy("cls").agg(F.max("n").alias("n_passage_words"))


def kept_texts(rows: DataFrame) -> DataFrame:
    """(cls, kept) of rows (cls, text, runs): the bytes of each text outside of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text, runs in zip(batch.column("cls"), batch.column("text"), batch.column("runs").to_pylist()):
                data, parts, at = text.as_buffer().to_pybytes(), [], 0
                for r in runs:
                    parts.append(data[at : r["s"]])
                    at = r["e"]
                kept = b"".join([*parts, data[at:]])
                yield pa.RecordBatch.from_arrays([pa.array([cls.as_py()], pa.string()), pa.array([kept], pa.binary())], names=["cls", "kept"])

    return rows.select("cls", "text", "runs").mapInArrow(run, "cls string, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed, classes = _texts(docs)
    both = repeats(keyed, [Symbols(1, LENGTH, GRAM), WORDS])
    found = written(removed(classes, both.runs[0]), "removals")
    shared = written(passages(classes, both, 1), "passages")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.md5(text).alias("key"))
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    # only texts of which a part stays are read beside their runs; one row for each text
    partly = found.where((F.size("runs") > 0) & (n < F.col("n_bytes"))).select("cls", "runs")
    cut = sifted(both.reps.select("cls", "text"), ["cls"], partly, ["cls"]).join(partly, "cls")
    cut = written(kept_texts(cut).select("cls", F.sha2("kept", 256).alias("sha")), "kept")
    discard(classes, both.reps, both.sizes, *both.runs)
    named = found.select("cls", n.alias("n_removed"), F.size("runs").cast("long").alias("n_spans")).join(cut, "cls", "left")
    named = named.join(shared, "cls", "left")
    rows = own.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("whole"))
    kept = F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return rows.join(named, F.col("key") == F.col("cls")).select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"))


OP10_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM documents
), st AS MATERIALIZED (
  SELECT r, i, md5_number(x[i + 1:i + {LENGTH}]) AS h FROM (SELECT r, x, unnest(range(0, octet_length(x) - {LENGTH - 1})) AS i FROM d WHERE octet_length(x) >= {LENGTH})
), twice AS (SELECT h FROM st GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS first FROM st WHERE h IN (SELECT h FROM twice)),
runs AS MATERIALIZED (SELECT r, g, min(i) AS s, max(i) + {LENGTH} AS e FROM (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
cuts AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS was FROM runs UNION ALL SELECT d.r, octet_length(x), NULL, coalesce((SELECT max(e) FROM runs WHERE runs.r = d.r), 0) FROM d),
kept AS (SELECT cuts.r, sha256(unhex(string_agg(hex(x[was + 1:s]), '' ORDER BY s, was))) AS sha FROM cuts JOIN d ON d.r = cuts.r GROUP BY cuts.r),
gone AS (SELECT r, sum(e - s) AS n, count(*) AS m FROM runs GROUP BY r),
wt AS MATERIALIZED (
  SELECT r, i, md5_number(array_to_string(w[i + 1:i + {WORDS.length}], ' ')) AS h FROM (SELECT r, w, unnest(range(0, len(w) - {WORDS.length - 1})) AS i FROM d WHERE len(w) >= {WORDS.length})
), shared AS (SELECT h FROM wt GROUP BY h HAVING min(r) <> max(r)),
whit AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {WORDS.length} THEN 0 ELSE 1 END AS first FROM wt WHERE h IN (SELECT h FROM shared)),
wruns AS (SELECT r, g, max(i) + {WORDS.length} - min(i) AS n FROM (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS g FROM whit) GROUP BY r, g),
words AS (SELECT r, sum(n) AS n FROM wruns GROUP BY r)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(gone.m, 0) AS BIGINT) AS n_spans, kept.sha AS kept_sha256, CAST(coalesce(words.n, 0) AS BIGINT) AS n_passage_words
FROM d JOIN kept ON kept.r = d.r LEFT JOIN gone ON gone.r = d.r LEFT JOIN words ON words.r = d.r
"""
