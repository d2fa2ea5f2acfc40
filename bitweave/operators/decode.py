"""Decoding segments: sequential inside a segment, parallel across segments.

What a plane's words mean depends on all bits before, so a segment is decoded
in one go by a Python function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions import tables as T
from bitweave.operators.entropy import PARTS, quantised

_WORDS = {key: {s: w for w, s in enumerate(symbols) if s >= 0} for key, symbols in T.SYMBOLS.items()}
_GROUP = [list(range(4 + 4 * f, 8 + 4 * f)) for f in range(3)], [[list(range(16 + 16 * f + 4 * k, 20 + 16 * f + 4 * k)) for k in range(4)] for f in range(3)]
_SUBBAND = np.array([T.place(i)[0] for i in range(T.BLOCK)])
#: Bits that a code has at most.
_LONGEST = 8


def _heads(size: int, option: int, kind: str) -> dict[str, tuple[int, int]]:
    """(word, bits of its code) by the next eight bits of the stream."""
    codes = [f"{s:0{size}b}" for s in range(1 << size)] if option < 0 else T.CODES[size, option].split(" ")
    word = _WORDS.get((size, kind), _WORDS[size, "any"])
    out = {}
    for symbol, code in enumerate(codes):
        if symbol in word:
            for k in range(1 << _LONGEST - len(code)):
                out[code + f"{k:0{_LONGEST}b}"[len(code) :]] = word[symbol], len(code)
    return out


_HEADS = {(size, kind): {option: _heads(size, option, kind) for option in (-1, *range((1 << (size - 1).bit_length()) - 1)) if option < size - 1} for size in (2, 3, 4) for kind in ("any", "tran_D", "types_H", "tran_H")}
#: Of the members of a group that are asked about (bits of the first number, the first member lowest), those that a word names.
_NAMED = [[sum(1 << i for k, i in enumerate(own) if word >> (len(own) - 1 - k) & 1) for word in range(1 << len(own))] for asked in range(16) for own in [[i for i in range(4) if asked >> i & 1]]]
_COUNT = [n.bit_count() for n in range(16)]


def _mask(members) -> int:
    return sum(1 << i for i in members)


class EndOfBits(Exception):
    """The stream was cut off; what was read so far holds."""


class BrokenStream(ValueError):
    """The stream holds a code that no encoder writes there."""


class Bits:
    """A stream of bits, most significant first."""

    def __init__(self, raw: bytes) -> None:
        self.s = bin(int.from_bytes(b"\1" + raw))[3:] + "0" * _LONGEST
        self.at, self.end = 0, 8 * len(raw)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise EndOfBits
        out = int(self.s[self.at : self.at + n], 2) if n else 0
        self.at += n
        return out

    def zeros(self) -> int:
        """Zeros up to the next one, which is taken too."""
        end = self.s.find("1", self.at, self.end)
        if end < 0:
            raise EndOfBits
        n, self.at = end - self.at, end + 1
        return n

    def some(self, n: int) -> np.ndarray:
        """The next n bits as numbers, or as many as there are."""
        n = min(n, self.end - self.at)
        out = np.frombuffer(self.s[self.at : self.at + n].encode(), np.uint8) - 48
        self.at += n
        return out


def signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _numbers(bits: Bits, n: int, size: int) -> list[int]:
    """The reference, plain, and the coded numbers after it."""
    if n == 1:
        return [bits.take(1) for _ in range(size)]
    out, width = [], (n - 1).bit_length()
    while len(out) < size:
        k = bits.take(width)
        if not out:
            out.append(bits.take(n))
        count = min(T.GAGGLE - len(out) % T.GAGGLE, size - len(out))
        if k == (1 << width) - 1:
            out += [bits.take(n) for _ in range(count)]
        else:
            high = [bits.zeros() for _ in range(count)]
            out += [h << k | bits.take(k) for h in high]
    return out


def _unfolded(numbers: list[int], low: int, high: int) -> list[int]:
    out = numbers[:1]
    for d in numbers[1:]:
        p = out[-1]
        theta = min(p - low, high - p)
        if d > 2 * theta:
            out.append(p + (d - theta if p - low < high - p else theta - d))
        else:
            out.append(p + (-(d + 1) // 2 if d % 2 else d // 2))
    return out


def decode_segment(raw: bytes, size: int, bdepth_dc: int, bdepth_ac: int, weights: Sequence[int] = T.WEIGHTS, wide_dc: bool = False, *, stop_plane: int = 0, stop_stage: int = 4, dc_only: bool = False, parts: Sequence[str] = PARTS) -> np.ndarray:
    """The blocks of a segment (size by 64), from its bits after the headers.

    A stream that ends early leaves the bits that it doesn't hold at 0, and so
    does a stop: stop_plane, stop_stage and dc_only say after what nothing is
    read. parts are those that the stream has.
    """
    bits, q = Bits(raw), quantised(bdepth_dc, bdepth_ac, weights[0])
    values, negative = np.zeros((size, T.BLOCK), dtype=np.int64), np.zeros(size, dtype=np.uint64)
    low, dc = np.zeros(size, dtype=np.int64), [0] * size
    n = max(bdepth_dc - q, 1)
    try:
        if "quant_dc" in parts:
            dc = _numbers(bits, n, size)
            dc[0] = signed(dc[0], n)
            half = 1 << (n if wide_dc else n - 1)
            dc = _unfolded(dc, -half, half - 1) if n > 1 else [signed(x, 1) for x in dc]
        if "additional_dc" in parts:
            for plane in range(q - 1, max(bdepth_ac, weights[0]) - 1, -1):
                _low_bits(bits, low, plane)
        if bdepth_ac and not dc_only:
            if "bdepth_ac" in parts:
                _numbers(bits, bdepth_ac.bit_length(), size)  # what depths are for shows in the planes
            for plane in range(bdepth_ac - 1, stop_plane - 1, -1):
                stages = [k for k in range(5) if f"stage_{k}" in parts and (plane > stop_plane or k <= stop_stage)]
                if 0 in stages and weights[0] <= plane < q:
                    _low_bits(bits, low, plane)
                _decode_plane(bits, plane, values, negative, weights, stages)
    except EndOfBits:
        pass
    signs = (negative[:, None] >> np.arange(T.BLOCK, dtype=np.uint64) & np.uint64(1)).astype(bool)
    values[signs] *= -1
    values[:, 0] = (np.array(dc, dtype=np.int64) << q) + low
    return values


def _low_bits(bits: Bits, low: np.ndarray, plane: int) -> None:
    """One DC bit of each block."""
    got = bits.some(len(low))
    low[: len(got)] |= got.astype(np.int64) << plane
    if len(got) < len(low):
        raise EndOfBits


def _decode_plane(bits: Bits, plane: int, values: np.ndarray, negative: np.ndarray, weights: Sequence[int], stages: Sequence[int]) -> None:
    open_ = np.asarray(weights)[_SUBBAND] <= plane
    seen = values != 0
    seen[:, 0] = False
    masks = (seen << np.arange(T.BLOCK, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    words = _Words(bits, masks.tolist(), _mask(np.flatnonzero(open_).tolist()))
    try:
        for k in stages:
            if 1 <= k <= 3:
                words.stage(k)
        if 4 in stages:
            asked = seen & open_
            got = bits.some(int(asked.sum()))
            rows, columns = (x[: len(got)] for x in np.nonzero(asked))
            values[rows, columns] |= got.astype(np.int64) << plane
            if len(got) < asked.sum():
                raise EndOfBits
    finally:
        found, minus = (np.array(x, dtype=np.uint64) for x in (words.found, words.minus))
        values |= (found[:, None] >> np.arange(T.BLOCK, dtype=np.uint64) & np.uint64(1)).astype(np.int64) << plane
        negative |= minus


class _Words:
    """Reads the words of one plane; the options of a gaggle are read with its first coded words.

    State is kept as bits: of a block's 64 coefficients for those found in this
    plane, of three families or four groups for those without any descendant.
    """

    ALL = _mask(range(4, T.BLOCK))
    CHILDREN = [_mask(g) for g in _GROUP[0]]
    GROUPS = [[_mask(g) for g in family] for family in _GROUP[1]]
    GRAND = [sum(family) for family in GROUPS]
    FAMILY = [c + g for c, g in zip(CHILDREN, GRAND, strict=True)]

    def __init__(self, bits: Bits, before: list[int], open_: int) -> None:
        self.bits, self.before, self.open = bits, before, open_
        self.found, self.minus = [0] * len(before), [0] * len(before)
        self.no_family = [0] * len(before)
        self.options: dict[tuple[int, int], int] = {}

    def word(self, b: int, n: int, kind: str) -> int:
        if n == 1:
            return self.bits.take(1)
        key = b // T.GAGGLE, n
        option = self.options.get(key)
        if option is None:
            width = (n - 1).bit_length()
            option = self.bits.take(width)
            option = self.options[key] = -1 if option == (1 << width) - 1 else option
        bits = self.bits
        head = _HEADS[n, kind][option].get(bits.s[bits.at : bits.at + _LONGEST])
        if head is None:
            if bits.at + _LONGEST > bits.end:
                raise EndOfBits
            raise BrokenStream(f"no word has the code at bit {bits.at}")
        word, length = head
        bits.at += length
        if bits.at > bits.end:
            raise EndOfBits
        return word

    def types(self, b: int, kind: str, first: int, group: int = 15) -> None:
        """Which of the coefficients from `first` on become significant, and their signs."""
        asked = (~self.before[b] & self.open) >> first & group
        if asked:
            new = _NAMED[asked][self.word(b, _COUNT[asked], kind)]
            if new:
                self.minus[b] |= _NAMED[new][self.bits.take(_COUNT[new])] << first
                self.found[b] |= new << first

    def flags(self, b: int, kind: str, masks: Sequence[int], none: int) -> int:
        """Groups without any member found, by flags of those not known to be without and not known to have one."""
        before, open_, asked = self.before[b], self.open, 0
        for k, mask in enumerate(masks):
            if not none >> k & 1 and not before & mask and open_ & mask:
                asked |= 1 << k
        return none | asked & ~_NAMED[asked][self.word(b, _COUNT[asked], kind)] if asked else none

    def stage(self, k: int) -> None:
        for b in range(len(self.before)):
            if k == 1:
                self.types(b, "any", 1, 7)
            elif k == 2:
                nothing = self.flags(b, "any", (self.ALL,), 0)
                none = self.no_family[b] = 7 if nothing else self.flags(b, "tran_D", self.FAMILY, 0)
                for f in range(3):
                    if not none >> f & 1:
                        self.types(b, "any", 4 + 4 * f)
            else:
                none = self.flags(b, "any", self.GRAND, self.no_family[b])
                if none == 7:
                    continue
                groups = [15 if none >> f & 1 else self.flags(b, "tran_H", self.GROUPS[f], 0) for f in range(3)]
                for f in range(3):
                    for g in range(4):
                        if not groups[f] >> g & 1:
                            self.types(b, "types_H", 16 + 16 * f + 4 * g)


def decoded(segments: DataFrame, weights: Sequence[int] = T.WEIGHTS, wide_dc: bool = False, *, stop_plane: int = 0, stop_stage: int = 4, dc_only: bool = False, parts: Sequence[str] = PARTS, skip_broken: bool = False) -> DataFrame:
    """segments: the key, size, bdepth_dc, bdepth_ac and data (binary) to one row for each block: b and content.

    Where segments have the number of their first block (start), the rows have blk, a block's number in its image.

    Segments are spread over all tasks, as decoding one takes long beside moving it.
    A stream that can't be what an encoder wrote is a BrokenStream error; with
    skip_broken it gives no blocks.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    blocks = decode_segment(r["data"], r["size"], r["bdepth_dc"], r["bdepth_ac"], r.get("weights") or weights, wide_dc, stop_plane=stop_plane, stop_stage=stop_stage, dc_only=dc_only, parts=parts)
                except BrokenStream:
                    if not skip_broken:
                        raise
                    continue
                for i in range(0, len(blocks), 4096):
                    part = blocks[i : i + 4096]
                    n = len(part)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * T.BLOCK + 1, T.BLOCK), pa.int32()), pa.array(part.ravel()))
                    blk = [pa.array(np.arange(i, i + n) + r["start"])] if placed else []
                    yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * n, pa.string()), pa.array([r["z"]] * n, pa.int32()), pa.array([r["segment_id"]] * n, pa.int64()), pa.array(np.arange(i, i + n)), lists, *blk], names=names)

    placed = "start" in segments.columns
    names = ["image_id", "z", "segment_id", "b", "content", *(["blk"] if placed else [])]
    own = [F.col("weights")] if "weights" in segments.columns else []
    own += [F.col("start").cast("bigint").alias("start")] if placed else []
    rows = segments.select("image_id", F.col("z").cast("int").alias("z"), F.col("segment_id").cast("bigint").alias("segment_id"), F.col("size").cast("bigint").alias("size"), "bdepth_dc", "bdepth_ac", "data", *own)
    return rows.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "z", "segment_id").mapInArrow(run, "image_id string, z int, segment_id bigint, b bigint, content array<bigint>" + (", blk bigint" if placed else ""))
