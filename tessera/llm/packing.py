"""Packing of tokenized documents into windows of ``window`` tokens, planned on the length histogram.

1. Documents are tokenized once; each becomes pieces: full windows and a tail. Every task numbers its
   pieces of each length, so a piece's rank among all pieces of its length is the task's offset plus
   that number. No piece moves to get its place, and one hot length needs no large group.
2. The histogram has at most ``window`` rows. Lengths are binned by ``grain``; all combinations of up
   to three bins that fill a window exactly are enumerated, and non-negative least squares finds repeat
   counts that reproduce the histogram. The active-set solution has no more combinations than there are bins, so
   rounding keeps nearly all of it; it is solved again for what is left until no count rounds to one.
3. What is left is packed greedily: combinations that still fill a window, then longest first into the fullest window that has room. Windows
   that still miss more than ``tolerance`` tokens are undone and their pieces laid end to end, cut at
   the window boundaries.

The plan is a list of (exact lengths, repeats); its size depends on the window, not on the data. A rank
then gives sequence and offset by a binary search.

Edge cases: a null or empty text is just the end token; repeated rows and null doc_ids are packed like
any others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

WINDOW = 2048
GRAIN = 8
TOLERANCE = 32
END_ID = 1
#: Rows of task offsets up to which they are broadcast (24 bytes each); beyond, the join shuffles.
MAX_BROADCAST_OFFSETS = 1 << 20

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary, task int, seq long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- tokens ---------------------------------------------------------------------------------------


def load_encoder(spec: str):
    """tiktoken encoding of a byte-level BPE ``tokenizers`` file: same ids, several times as fast."""
    import public_tokenizers
    import tiktoken

    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    model = json.loads(spec)
    special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenized(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents (PIECES), written. ``tokenizer``: the text of the tokenizer's file."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = load_encoder(spec.value), TaskContext.get().partitionId(), Counter()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    n = len(piece)
                    tail = piece.astype("<u2" if encoder.n_vocab <= 1 << 16 else "<u4").tobytes() if n < window else None
                    out.append((doc_id.as_py(), at, n, zlib.crc32(piece.tobytes()), len(ids), tail, task, seen[n]))
                    seen[n] += 1
                    held += 80 + 2 * n
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, PIECES), "pieces")


# -- plan -----------------------------------------------------------------------------------------


def combinations_filling(units: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of one to three bins, all of them present, that sum to ``units``."""
    found: list[tuple[int, ...]] = [(units,)] if present[units] else []
    for a in range(1, units):
        if present[a]:
            if a <= units - a and present[units - a]:
                found.append((a, units - a))
            found += [(a, b, units - a - b) for b in range(a, (units - a) // 2 + 1) if units - a - b >= b and present[b] and present[units - a - b]]
    return found


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative x of least |matrix x - target|, by active sets; at most as many values as rows are not 0."""
    x = np.zeros(matrix.shape[1])
    chosen: list[int] = []  # columns that may be positive
    for _ in range(3 * len(target)):
        slope = matrix.T @ (target - matrix[:, chosen] @ x[chosen])
        slope[chosen] = 0
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        chosen.append(best)
        while True:
            part = matrix[:, chosen]
            free = np.linalg.lstsq(part, target, rcond=None)[0]
            if free.min() > 0:
                x[chosen] = free
                break
            now = x[chosen]
            low = np.flatnonzero(free <= 0)
            share = (now[low] / np.maximum(now[low] - free[low], 1e-300)).min()
            now = now + share * (free - now)
            x[chosen] = now
            gone = {chosen[i] for i in low if now[i] <= 1e-12}
            if not gone:
                gone = {chosen[int(low[np.argmin(now[low])])]}
            for i in gone:
                x[i] = 0.0
            chosen = [i for i in chosen if i not in gone]
            if not chosen:
                break
    return x


def by_squares(left: np.ndarray, combos: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """(bins, repeats) by least squares; ``left``, how many pieces a bin holds, is brought down to the rest."""
    chosen: list[tuple[tuple[int, ...], int]] = []
    while combos:
        matrix = np.zeros((len(left), len(combos)))
        for k, combo in enumerate(combos):
            for b in combo:
                matrix[b, k] += 1
        scale = float(max(1, left.max()))
        x = nnls(matrix, left / scale) * scale
        placed = 0
        for k in np.argsort(-x, kind="stable"):
            need = Counter(combos[k])
            n = int(min(min(left[b] // m for b, m in need.items()), np.round(x[k])))
            if n > 0:
                chosen.append((combos[k], n))
                placed += n
                for b, m in need.items():
                    left[b] -= m * n
        combos = [c for c in combos if all(left[b] >= m for b, m in Counter(c).items())]
        if not placed:
            break
    return chosen


def whole_combinations(left: np.ndarray, combos: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """(bins, repeats) of what of the rest still fills windows, greedily."""
    chosen = []
    for combo in combos:
        need = Counter(combo)
        n = int(min(left[b] // m for b, m in need.items()))
        if n > 0:
            chosen.append((combo, n))
            for b, m in need.items():
                left[b] -= m * n
    return chosen


def greedy(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): longest first, into the fullest windows that have room."""
    open_: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, repeats]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int, room: int) -> None:
        if room not in open_ or not open_[room]:
            insort(rooms, room)
        open_[room].append([lengths, n])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = window // length
                if n >= each:
                    put((length,) * each, n // each, window - each * length)
                if n % each:
                    put((length,) * (n % each), 1, window - n % each * length)
                break
            room = rooms[at]
            lengths, repeats = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, n)
            used = min(repeats, n // each)
            put(lengths + (length,) * each, used, room - each * length)
            if repeats > used:
                put(lengths, repeats - used, room)
            n -= used * each
    return [(tuple(x), n) for group in open_.values() for x, n in group]


def make_plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, tolerance: int = TOLERANCE) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, kind, sequence or position, offset).

    kind 0: rank r lies in sequence ``sequence + r - first`` at ``offset``. kind 1: the pieces are laid
    end to end from ``position`` of the stream that starts at sequence ``offset``.
    """
    plan: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0

    def place(lengths: tuple[int, ...], n: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            plan[length].append((used[length], 0, sequence, offset))
            used[length] += n
            offset += length
        sequence += n

    # full windows need no partner
    rest = {k: n for k, n in histogram.items() if k < window}
    if histogram.get(window):
        place((window,), histogram[window])
    queue = defaultdict(list)  # by bin: [length, left], ascending
    for length in sorted(rest):
        queue[-(-length // grain)].append([length, rest[length]])
    left_in = np.zeros(window // grain + 1, np.int64)
    for length, n in rest.items():
        left_in[-(-length // grain)] += n
    combos = combinations_filling(window // grain, left_in > 0)
    for bins, n in by_squares(left_in, combos) + whole_combinations(left_in, combos):
        while n:
            take: list[int] = []
            cursor: Counter = Counter()
            run = n
            for b in bins:  # the next exact lengths of each bin; a bin may occur twice
                k, at = cursor[b], 0
                while queue[b][at][1] <= k:
                    k -= queue[b][at][1]
                    at += 1
                take.append(queue[b][at][0])
                cursor[b] += 1
            need = Counter(take)
            for b in set(bins):
                for length, left in queue[b]:
                    if length in need:
                        run = min(run, left // need[length])
            place(tuple(take), run)
            for b in set(bins):
                for x in queue[b]:
                    x[1] -= run * need.get(x[0], 0)
                queue[b] = [x for x in queue[b] if x[1]]
            n -= run
    left = {length: n for group in queue.values() for length, n in group if n}
    stream: Counter = Counter()
    for lengths, n in greedy(left, window):
        if window - sum(lengths) <= tolerance:
            place(lengths, n)
        else:
            for length in lengths:
                stream[length] += n
    position = 0
    for length in sorted(stream, reverse=True):
        plan[length].append((used[length], 1, position, sequence))
        used[length] += stream[length]
        position += length * stream[length]
    return dict(plan)


# -- places ---------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN, tolerance: int = TOLERANCE, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and offset (PACKED)."""
    pieces = tokenized(docs, tokenizer, window, end_id)
    counts = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window, grain, tolerance))
    width = 2 if len(json.loads(tokenizer)["model"]["vocab"]) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        firsts = {k: [x[0] for x in v] for k, v in plan.value.items()}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                n, rank = row["length"], row["before"] + row["seq"]
                first, kind, a, b = plan.value[n][bisect_right(firsts[n], rank) - 1]
                if kind == 0:
                    out.append((row["doc_id"], row["start"], n, row["ids_crc32"], row["doc_tokens"], a + rank - first, b))
                    continue
                position, done = a + (rank - first) * n, 0
                ids = np.frombuffer(row["ids"], f"<u{width}").astype("<u4")
                while done < n:
                    part = min(n - done, window - position % window)
                    out.append((row["doc_id"], row["start"] + done, part, zlib.crc32(ids[done : done + part].tobytes()), row["doc_tokens"], b + position // window, position % window))
                    position, done = position + part, done + part
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    small = counts.count() <= MAX_BROADCAST_OFFSETS
    placed = pieces.join(F.broadcast(offsets) if small else offsets, ["task", "length"])
    return placed.mapInArrow(run, PACKED)


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
