"""From blocks to a segment's packed bits: differences, words, code options and the order of the stream.

The words of a gaggle in one plane share a code option for each word length,
the one with the fewest bits (sent plain on ties, then the lower option). The
option stands before the first word of its length. The stream has all blocks of
a stage before the next stage, so a segment is put together as a whole: its
blocks meet in one task, by the only shuffle, and are coded as matrices of
words by blocks, a stretch of gaggles at a time. No word is ever a row. A task
holds a segment's blocks (512 bytes each) and its packed bits.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions import tables as T
from bitweave.operators import words
from bitweave.operators.rice import MOST_K
from bitweave.operators.segments import KEY

OPTIONS = {2: (0,), 3: (0, 1), 4: (0, 1, 2)}
#: Parts of a stream that can be left out, to find where two streams part.
PARTS = ("quant_dc", "additional_dc", "bdepth_ac", "stage_0", "stage_1", "stage_2", "stage_3", "stage_4")
#: Blocks whose words are held at a time, in whole gaggles.
STRETCH = 64 * T.GAGGLE

_SYMBOLS = {key: np.maximum(np.array(symbols), 0) for key, symbols in T.SYMBOLS.items()}


@functools.cache
def _symbols(size: int, kinds: tuple[str, ...]) -> np.ndarray:
    """The symbols of words of a length, a row for each kind of word."""
    return np.stack([_SYMBOLS.get((size, kind), _SYMBOLS[size, "any"]) for kind in kinds])


_CODE = {n: np.array([[s for s in range(1 << n)], *([int(c, 2) for c in T.CODES[n, o].split(" ")] for o in options)]) for n, options in OPTIONS.items()}
_SIZE = {n: np.array([[n] * (1 << n), *([len(c) for c in T.CODES[n, o].split(" ")] for o in options)]) for n, options in OPTIONS.items()}
_SUBBAND = np.array([T.place(i)[0] for i in range(T.BLOCK)])


@dataclass(frozen=True)
class Rules:
    """How a segment is coded; see plans.codec.Settings."""

    heuristic_dc: bool = False
    heuristic_ac: bool = False
    compat: bool = False
    stop_plane: int = 0
    stop_stage: int = 4
    dc_only: bool = False
    parts: tuple[str, ...] = PARTS


class Bits:
    """Packed bits that grow at the end."""

    def __init__(self) -> None:
        self.whole, self.rest, self.n = [], np.zeros(0, np.uint8), 0

    def put(self, lens: np.ndarray, values: np.ndarray) -> None:
        """The low bits of numbers from 0 on; a number may be shorter than its length."""
        lens = lens.astype(np.int64)
        shift = np.repeat(np.cumsum(lens) - 1, lens) - np.arange(lens.sum())
        self.put_bits((np.repeat(values, lens) >> np.minimum(shift, 63) & 1).astype(np.uint8))

    def put_bits(self, bits: np.ndarray) -> None:
        self.n += len(bits)
        bits = np.concatenate([self.rest, bits])
        full = len(bits) // 8 * 8
        self.whole.append(np.packbits(bits[:full]).tobytes())
        self.rest = bits[full:]

    def join(self, other: Bits) -> None:
        self.put_bits(np.unpackbits(np.frombuffer(other.bytes(), np.uint8))[: other.n])

    def bytes(self) -> bytes:
        """All bits, with zeros up to a whole byte."""
        return b"".join([*self.whole, np.packbits(self.rest).tobytes()])


def _width(x) -> np.ndarray:
    """Bits of numbers from 0 on."""
    x = np.asarray(x, dtype=np.int64)
    out = np.zeros(x.shape, dtype=np.int64)
    while x.any():
        out += x > 0
        x = x >> 1
    return out


def quantised(dc: int, ac: int, weight: int) -> int:
    """How many low bits of DC are coded by planes: half of AC's depth and one more, but so that 3 to 10 bits of DC are left."""
    half = 1 + ac // 2
    q = 0 if dc <= 3 else dc - 3 if dc - half <= 1 else dc - 10 if dc - half > 10 else half
    return max(q, weight)


class Segment:
    """A segment's blocks with its statistics."""

    def __init__(self, content: np.ndarray, weights: Sequence[int]) -> None:
        self.content, self.weights = content, weights
        dc = content[:, 0]
        self.depth = _width(np.bitwise_or.reduce(np.abs(content[:, 1:]), axis=1))
        self.bdepth_dc = 1 + int(np.bitwise_or.reduce(np.where(dc < 0, ~dc, dc))).bit_length()
        self.bdepth_ac = int(self.depth.max())
        self.q = quantised(self.bdepth_dc, self.bdepth_ac, weights[0])


def _folded(value: np.ndarray, low: int, high: int) -> np.ndarray:
    """Differences to the number before, as numbers from 0 on; the first one is 0."""
    before = np.concatenate([value[:1], value[:-1]])
    d, theta = value - before, np.minimum(before - low, high - before)
    return np.where((d >= 0) & (d <= theta), d * 2, np.where((d < 0) & (-d <= theta), -d * 2 - 1, theta + np.abs(d)))


def _k(sums: np.ndarray, n: int, j: np.ndarray, heuristic: bool, plain_only: bool) -> np.ndarray:
    """k of each gaggle, by the rules of rice.k_optimal and rice.k_heuristic; sums of the numbers above each k."""
    if n <= 1:
        return np.full(len(j), -1)
    if heuristic:
        total, bound = sums[0], sums[0] * 128 + j * 49
        middle = np.maximum(_width(bound // np.maximum(j, 1)) - 8, 0)
        return np.where((total * 64 >= j * 23 << n) | (j == 0), -1, np.where(j * 207 > total * 128, 0, np.where(j << n + 5 <= bound, n - 2, middle)))
    size = np.stack([sums[k] + j + (0 if plain_only else j * k) for k in range(MOST_K + 1) if k == 0 or k <= n - 2])
    return np.where(size.min(axis=0) >= n * j, -1, size.argmin(axis=0))


def _rice(out: Bits, numbers: np.ndarray, n: int, reference: int, heuristic: bool, plain_only: bool) -> None:
    """All gaggles' numbers: k, the reference in the first, then the numbers' parts above k and those below."""
    gaggles = -(-len(numbers) // T.GAGGLE)
    d = np.zeros((gaggles, T.GAGGLE), dtype=np.int64)
    here = np.zeros((gaggles, T.GAGGLE), dtype=bool)
    d.ravel()[: len(numbers)] = numbers
    here.ravel()[1 : len(numbers)] = True
    d[~here] = 0
    k = _k(np.stack([(d >> i).sum(axis=1) for i in range(MOST_K + 1)]), n, here.sum(axis=1), heuristic, plain_only)
    width = (n - 1).bit_length()
    low = np.maximum(k, 0)[:, None]
    plain = (k < 0)[:, None]
    first = np.arange(gaggles)[:, None] == 0
    lens = [np.full((gaggles, 1), width), np.where(first, n, 0), np.where(here, np.where(plain, n, (d >> low) + 1), 0), np.where(here & ~plain, low, 0)]
    values = [k[:, None] & (1 << width) - 1, np.where(first, reference & (1 << n) - 1, 0), np.where(plain, d & (1 << n) - 1, 1), d & (1 << low) - 1]
    out.put(np.concatenate(lens, axis=1).ravel(), np.concatenate(values, axis=1).ravel())


class Plane:
    """The words of one plane of a stretch of blocks, with their symbols and the code options of its gaggles."""

    def __init__(self, content: np.ndarray, depth: int, q: int, plane: int, weights: Sequence[int]) -> None:
        n = len(content)
        rows = [(stage, seq, kind, length, value) for stage, seq, kind, length, value in words.plane_words(content, plane, weights)]
        if weights[0] <= plane < q:
            rows.append((0, 0, "dc", np.ones(n, np.int64), content[:, 0] >> plane & 1))
        magnitude = np.abs(content[:, 1:])
        asked = (magnitude >> (plane + 1) > 0) & (np.asarray(weights)[_SUBBAND[1:]] <= plane)
        rows.append((4, 0, "refinement", *words.folded(asked, magnitude >> plane & 1)))
        rows.sort(key=lambda r: r[:2])
        self.stage, self.seq = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.len, self.value = np.stack([r[3] for r in rows]).astype(np.int64), np.stack([r[4] for r in rows]).astype(np.int64)
        coded = np.array([r[2][0] == "t" for r in rows])[:, None] & (self.len > 1)  # types and transitions
        self.begin = np.arange(0, n, T.GAGGLE)
        self.gaggle = np.arange(n) // T.GAGGLE
        self.own = {size: coded & (self.len == size) for size in OPTIONS}
        self.symbol, kinds = np.zeros_like(self.value), tuple(r[2] for r in rows)
        for size, own in self.own.items():
            self.symbol = np.where(own, np.take_along_axis(_symbols(size, kinds), np.where(own, self.value, 0), axis=1), self.symbol)
        self.option, self.bits, self.count = {}, {}, {}
        for size, own in self.own.items():
            symbol = np.where(own, self.symbol, 0)
            cost = np.stack([np.add.reduceat(np.where(own, s[symbol], 0).sum(axis=0), self.begin) for s in _SIZE[size]])
            self.option[size], self.bits[size] = cost.argmin(axis=0) - 1, cost.min(axis=0)
            self.count[size] = np.add.reduceat(own.sum(axis=0), self.begin)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, values) of what is sent for each word, with the option before the first word of its length."""
        lens, values = self.len.copy(), self.value.copy()
        blocks = np.arange(lens.shape[1])
        for size, own in self.own.items():
            if not own.any():
                continue
            row = (self.option[size] + 1)[self.gaggle]
            lens = np.where(own, _SIZE[size][row, np.where(own, self.symbol, 0)], lens)
            values = np.where(own, _CODE[size][row, np.where(own, self.symbol, 0)], values)
            order = np.where(own, (self.stage[:, None] * len(blocks) + blocks) * 64 + self.seq[:, None], np.iinfo(np.int64).max)
            first = own & (order == np.minimum.reduceat(order.min(axis=0), self.begin)[self.gaggle])
            width = (size - 1).bit_length()
            values += np.where(first, (self.option[size][self.gaggle] & (1 << width) - 1) << lens, 0)
            lens += np.where(first, width, 0)
        return lens, values


def planes(segment: Segment) -> Iterator[tuple[int, int, Plane]]:
    """(plane, first block, Plane) of all stretches, from the highest plane down."""
    for plane in range(segment.bdepth_ac - 1, -1, -1):
        for at in range(0, len(segment.content), STRETCH):
            yield plane, at, Plane(segment.content[at : at + STRETCH], segment.bdepth_ac, segment.q, plane, segment.weights)


def encode(segment: Segment, rules: Rules = Rules()) -> Bits:  # noqa: B008
    """All bits of a segment, without headers.

    stop_plane, stop_stage and dc_only end the stream early: below that plane,
    or in it after that stage, nothing is sent; dc_only sends nothing after the
    plain DC planes. compat follows an older coder's rules for the range of DC
    differences and the choice of k.
    """
    out, dc, parts = Bits(), segment.content[:, 0], rules.parts
    if "quant_dc" in parts:
        n = max(segment.bdepth_dc - segment.q, 1)
        dc_q, half = dc >> segment.q, 1 << (n if rules.compat else n - 1)
        _rice(out, _folded(dc_q, -half, half - 1) if n > 1 else dc_q & 1, n, int(dc_q[0]), rules.heuristic_dc, rules.compat)
    if "additional_dc" in parts:
        for plane in range(segment.q - 1, max(segment.bdepth_ac, segment.weights[0]) - 1, -1):
            out.put_bits((dc >> plane & 1).astype(np.uint8))
    if rules.dc_only or not segment.bdepth_ac:
        return out
    if "bdepth_ac" in parts:
        n = segment.bdepth_ac.bit_length()
        _rice(out, _folded(segment.depth, 0, (1 << n) - 1) if n > 1 else segment.depth, n, int(segment.depth[0]), rules.heuristic_ac, rules.compat)
    stages, last = [Bits() for _ in range(5)], None

    def close() -> None:
        for k in range(5):
            out.join(stages[k])
            stages[k] = Bits()

    for plane, _, words_ in planes(segment):
        if plane < rules.stop_plane:
            break
        if plane != last:
            close()
            last = plane
        lens, values = words_.codes()
        for stage in range(5):
            if f"stage_{stage}" in parts and (plane > rules.stop_plane or stage <= rules.stop_stage):
                own = words_.stage == stage
                stages[stage].put(lens[own].T.ravel(), values[own].T.ravel())
    close()
    return out


def _grouped(segmented: DataFrame, columns: str, rows_of: Callable[[int, np.ndarray], list[tuple]]) -> DataFrame:
    """Rows made from each whole segment, given its number and its blocks in order; one shuffle."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = _parse_datatype_string(f"image_id string, z int, segment_id bigint, {columns}")
    assert isinstance(schema, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        content = table.column("content").combine_chunks()
        content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
        blocks = content.flatten().to_numpy().reshape(-1, T.BLOCK)[np.argsort(table.column("b").to_numpy())]
        key = tuple(table.column(c)[0].as_py() for c in KEY)
        rows = [key + r for r in rows_of(key[2], blocks)]
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], names=kinds.names)

    own = segmented.select(F.col("image_id").cast("string").alias("image_id"), F.col("z").cast("int").alias("z"), F.col("segment_id").cast("bigint").alias("segment_id"), "b", "content")
    return own.groupBy(*KEY).applyInArrow(run, schema)


def segment_bits(segmented: DataFrame, weights: Sequence[int] = T.WEIGHTS, rules: Rules | Callable[[int], Rules] = Rules()) -> DataFrame:  # noqa: B008
    """All bits of each segment, without headers: the segment's key, size, bdepth_dc, bdepth_ac, q, n_bits and bits (packed).

    rules: the same for all segments, or a function of the segment's number.
    """
    weights = [int(w) for w in weights]

    def rows(number: int, blocks: np.ndarray) -> list[tuple]:
        segment = Segment(blocks, weights)
        bits = encode(segment, rules if isinstance(rules, Rules) else rules(number))
        return [(len(blocks), segment.bdepth_dc, segment.bdepth_ac, segment.q, bits.n, bits.bytes())]

    return _grouped(segmented, "size bigint, bdepth_dc int, bdepth_ac int, q int, n_bits bigint, bits binary", rows)


def gaggle_options(segmented: DataFrame, weights: Sequence[int] = T.WEIGHTS) -> DataFrame:
    """One row for each gaggle, plane and word length: the option (-1: plain), the words (n) and their coded bits."""
    weights = [int(w) for w in weights]

    def rows(_: int, blocks: np.ndarray) -> list[tuple]:
        return [(plane, at // T.GAGGLE + g, size, int(p.option[size][g]), int(n), int(p.bits[size][g])) for plane, at, p in planes(Segment(blocks, weights)) for size in OPTIONS for g, n in enumerate(p.count[size]) if n]

    return _grouped(segmented, "plane int, gaggle bigint, len int, option int, n bigint, bits bigint", rows)


def symbol_counts(segmented: DataFrame, weights: Sequence[int] = T.WEIGHTS) -> DataFrame:
    """How often each symbol of each word length is sent in a plane of a segment."""
    weights = [int(w) for w in weights]

    def rows(_: int, blocks: np.ndarray) -> list[tuple]:
        found: dict[tuple, int] = {}
        for plane, _, p in planes(Segment(blocks, weights)):
            for size, own in p.own.items():
                for symbol, n in enumerate(np.bincount(p.symbol[own], minlength=1)):
                    found[plane, size, symbol] = found.get((plane, size, symbol), 0) + int(n)
        return [(*key, n) for key, n in found.items() if n]

    return _grouped(segmented, "plane int, len int, sym int, n bigint", rows)


def stage_lengths(segmented: DataFrame, weights: Sequence[int] = T.WEIGHTS) -> DataFrame:
    """Bits of each stage of each plane of a segment."""
    weights = [int(w) for w in weights]

    def rows(_: int, blocks: np.ndarray) -> list[tuple]:
        found: dict[tuple, int] = {}
        for plane, _, p in planes(Segment(blocks, weights)):
            lens = p.codes()[0].sum(axis=1)
            for stage, n in zip(p.stage.tolist(), lens.tolist(), strict=True):
                found[plane, stage] = found.get((plane, stage), 0) + n
        return [(*key, n) for key, n in found.items() if n]

    return _grouped(segmented, "plane int, stage int, bits bigint", rows)
