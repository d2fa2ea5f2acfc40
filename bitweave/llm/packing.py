"""Best-fit packing of token runs by exact-complement hashing.

Documents longer than a sequence are cut into whole sequences from their end,
so only a first piece is shorter. All else depends on piece lengths alone, and
a histogram of lengths has at most as many rows as a sequence has tokens. The
plan is made on that histogram: single, pair and triple length sums are looked
up to fill a gap exactly, as often as their counts allow, and what is left is
packed best-fit. Exact fills that use up the lengths which the rest needs cost
sequences in the end, so they stop where the whole plan is shortest. A plan is
a list of patterns (lengths) with multiplicities.

Pieces are then numbered within their length without gathering a length
anywhere: a task numbers its own, and adds how many of that length the tasks
before it have. The number of a piece gives its pattern, copy and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.llm import tokens
from bitweave.llm.common import bounded_batches, lean, stored

CAPACITY = 1024
#: Numbers of exact fills, evenly spaced, at which the plan is weighed.
STOPS = 48


def _exact(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of two to four lengths that fill a sequence exactly, in the order in which they are consumed.

    First all gaps that a single length fills, then those for the pair sums,
    then the triple sums. Lengths from half a sequence up go first, as they
    leave the widest gaps, and a gap takes parts of like size before unlike
    ones, so the short lengths are left for gaps that nothing fills exactly.
    Every step uses up some length, so there are few steps. Lowers count.
    """
    out = []

    def pair(gap: int, own: dict[int, int], top: int) -> tuple[int, ...] | None:
        b = np.arange((gap + 1) // 2, min(gap - 1, top) + 1)
        for x in b[(count[b] > 0) & (count[gap - b] > 0)].tolist():
            y = gap - x
            if count[x] > own.get(x, 0) + (x == y) and count[y] > own.get(y, 0):
                return x, y
        return None

    def fill(a: int, parts: int) -> tuple[int, ...] | None:
        own, gap = {a: 1}, capacity - a
        if parts == 1:
            return (gap,) if gap <= a and count[gap] > own.get(gap, 0) else None
        if parts == 2:
            return pair(gap, own, a)
        for b in range((gap + 2) // 3, min(gap - 2, a) + 1):
            if count[b] > own.get(b, 0) and (two := pair(gap - b, own | {b: own.get(b, 0) + 1}, b)):
                return b, *two
        return None

    half = capacity // 2
    for parts in (1, 2, 3):
        for a in (*range(half, capacity), *range(half - 1, 0, -1)):
            while count[a] > 0 and (rest := fill(a, parts)):
                pattern = (a, *rest)
                times = min(int(count[x]) // pattern.count(x) for x in set(pattern))
                for x in pattern:
                    count[x] -= times
                out.append((pattern, times))
    return out


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on what is left; open sequences of one content are handled together."""
    gaps: list[int] = []
    open_: dict[int, list[list]] = {}

    def add(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap not in open_:
            insort(gaps, gap)
            open_[gap] = []
        open_[gap].append([pattern, times])

    for a in range(capacity, 0, -1):
        left, count[a] = int(count[a]), 0
        while left:
            k = bisect_left(gaps, a)
            if k == len(gaps):
                each = capacity // a
                if left >= each:
                    add(capacity - each * a, (a,) * each, left // each)
                    left %= each
                if left:
                    add(capacity - left * a, (a,) * left, 1)
                break
            gap = gaps[k]
            pattern, times = open_[gap].pop()
            used = min(times, left)
            if times > used:
                open_[gap].append([pattern, times - used])
            if not open_[gap]:
                del open_[gap], gaps[k]
            add(gap - a, (*pattern, a), used)
            left -= used
    return [(tuple(p), t) for rows in open_.values() for p, t in rows]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; all pieces are placed."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    out = [((capacity,), int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    fills = _exact(count.copy(), capacity)
    stops = sorted({len(fills) * k // STOPS for k in range(STOPS + 1)})
    plans, done = [], 0
    for stop in stops:
        for pattern, times in fills[done:stop]:
            for x in pattern:
                count[x] -= times
        done = stop
        rest = _best_fit(count.copy(), capacity)
        plans.append((sum(t for _, t in fills[:stop]) + sum(t for _, t in rest), -stop, rest))
    _, stop, rest = min(plans, key=lambda p: p[:2])  # of equal plans the one with the most exact fills
    return out + fills[:-stop] + rest


class Places:
    """Where the i-th piece of a length goes, for every length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        rows: dict[int, list] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, times in patterns:
            at, places = 0, {}
            for length in pattern:
                places.setdefault(length, []).append(at)
                at += length
            for length, offsets in places.items():
                rows.setdefault(length, []).append((used.get(length, 0), base, offsets))
                used[length] = used.get(length, 0) + times * len(offsets)
            base += times
        self.rows = {n: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.array([len(r[2]) for r in x]), np.cumsum([0] + [len(r[2]) for r in x[:-1]]), np.array([o for r in x for o in r[2]])) for n, x in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces numbered from 0 within their length."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            first, base, slots, begin, offsets = self.rows[int(n)]
            k = np.searchsorted(first, rank[own], side="right") - 1
            i = rank[own] - first[k]
            sequence[own], offset[own] = base[k] + i // slots[k], offsets[begin[k] + i % slots[k]]
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, capacity: int = CAPACITY, chunk: int = tokens.CHUNK, keep_pieces: int = tokens.KEEP) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` tokens.

    Returns one row for each piece: the id column, piece, start, length,
    ids_crc32, sequence_id and offset (gapless from 0 in each sequence). Null
    text is empty and holds the end id alone. Rows with equal or null ids are
    packed one by one. A text without ids (end_id None) gives no piece. Extra
    columns are not read; an empty table gives no rows. chunk and keep_pieces
    bound the memory of a worker's encoder and change no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(tokens.vocabulary(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(tokens.encoded(batch.column(1), spec.value, end_id, chunk, keep_pieces)):
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if not k else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    rank.append(seen[size])
                    seen[size] += 1
                    at, k = at + size, k + 1
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part)), pa.array(rank, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    pieces = stored(docs.mapInArrow(lean(cut, tokens.KEPT), f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"), "pieces")
    return place(pieces, capacity).withColumnRenamed("id", id_col)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give pieces (with part, length, and rank from 0 within both) a sequence_id and an offset."""
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    parts = stored(parts, "lengths")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = parts.selectExpr("part", "length", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before")

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = places.value.find(length, batch.column(batch.schema.get_field_index("at")).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = pieces.join(before.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("at"))
    kind = pieces.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(lean(run, tokens.KEPT), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
