"""Words of the bit planes, as closed forms of the coefficients' magnitudes.

A coefficient is significant before plane b if its magnitude has a bit above b.
So each plane of each block is coded by itself, without the state that a
sequential coder carries from plane to plane. The words of a batch of blocks
are matrix operations over (blocks, coefficients) in a map over Arrow batches:
as column expressions they would be thousands of nodes for each row. Nothing is
shuffled, and empty words never become rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions import bits as B
from bitweave.functions import tables as T
from bitweave.operators.segments import KEY

WORDS = "image_id string, z int, segment_id bigint, b bigint, gaggle bigint, plane int, stage int, seq int, kind string, len int, val bigint, raw string"
#: Stages of a plane, in the order of the stream; the words of a stage go block by block.
STAGES = ("dc", "parents", "children", "grandchildren", "refinement")

#: Indices of children by family, and of grandchildren by family and group.
_CHILDREN = np.arange(4, 16).reshape(3, 4)
_GROUPS = np.arange(16, T.BLOCK).reshape(3, 4, 4)
_SUBBAND = np.array([T.place(i)[0] for i in range(T.BLOCK)])


def folded(asked: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, value) of the asked bits along the last axis, the first one on top."""
    kind = np.int16 if asked.shape[-1] < 15 else np.int64
    upto = asked.cumsum(axis=-1, dtype=kind)
    n = upto[..., -1]
    return n, ((asked & (bits != 0)).astype(kind) << n[..., None] - upto).sum(axis=-1, dtype=kind)


def _levels(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether anything holds among all descendants, those of each family, grandchildren of each, and groups of them."""
    groups = x[..., _GROUPS].any(axis=-1)
    grand = groups.any(axis=-1)
    family = grand | x[..., _CHILDREN].any(axis=-1)
    return family.any(axis=-1, keepdims=True), family, grand, groups


def plane_words(content: np.ndarray, plane: int, weights: Sequence[int]):
    """Yield (stage, seq, kind, lengths, values) over all blocks; content is blocks by 64 coefficients."""
    magnitude, negative = np.abs(content), content < 0
    now, above = (magnitude >> plane & 1).astype(bool), magnitude >> (plane + 1) > 0
    open_ = np.asarray(weights)[_SUBBAND] <= plane
    free = ~above & open_
    held, hit, may = _levels(above), _levels(now), _levels(open_)

    def types(stage: int, seqs: Sequence[int], kind: str, groups: np.ndarray, none: np.ndarray | None):
        """The words of several groups, and their signs."""
        asked = free[:, groups] if none is None else free[:, groups] & ~none[..., None]
        found = now[:, groups]
        shape = len(content), -1
        (length, value), (signs, minus) = ([x.reshape(shape) for x in folded(*y)] for y in ((asked, found), (asked & found, negative[:, groups])))
        for k, seq in enumerate(seqs):
            yield stage, seq, kind, length[:, k], value[:, k]
            yield stage, seq + 1, "signs", signs[:, k], minus[:, k]

    def flags(level: int, none: np.ndarray):
        """(word, which groups end the descent): a flag is sent if nothing of its group was significant before."""
        sent = ~held[level] & may[level] & ~none
        return folded(sent, hit[level]), sent & ~hit[level] | none

    yield from types(1, [0], "types_P", np.array([[1, 2, 3]]), None)
    word, none = flags(0, np.zeros((len(content), 1), dtype=bool))
    yield 2, 0, "tran_B", *word
    word, no_family = flags(1, none)
    yield 2, 1, "tran_D", *word
    word, no_grand = flags(2, no_family)
    yield 3, 0, "tran_G", *word
    yield from types(2, [2, 4, 6], "types_C", _CHILDREN, no_family)
    (length, value), no_group = flags(3, no_grand[..., None])
    for f in range(3):
        yield 3, 1 + f, "tran_H", length[:, f], value[:, f]
    yield from types(3, range(4, 28, 2), "types_H", _GROUPS, no_group)


def _strings(asked: np.ndarray, bits: np.ndarray) -> pa.Array:
    """The asked bits of each row as a string of 0 and 1."""
    text = (bits[asked] + np.uint8(48)).astype(np.uint8).tobytes()
    ends = np.concatenate([[0], np.cumsum(asked.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(asked), pa.py_buffer(ends.tobytes()), pa.py_buffer(text))


def words(segmented: DataFrame, stats: DataFrame, weights: Sequence[int] = T.WEIGHTS) -> DataFrame:
    """The non-empty words of every block and plane, one row each (columns of WORDS).

    kind: dc (a DC bit below the quantisation), types_P, types_C, types_H
    (which coefficients become significant), signs (theirs), tran_B, tran_D,
    tran_G, tran_H (whether any descendant of a group does), refinement (bits
    of coefficients significant before, in raw). seq orders a block's words
    within a stage. Segments without AC planes have none.
    """
    weights = [int(w) for w in weights]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, q = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            content = batch.column(7).flatten().to_numpy().reshape(-1, T.BLOCK)
            for plane in range(int(depth.max()) - 1, -1, -1):
                rows = np.flatnonzero(depth > plane)
                own = content[rows]
                parts = []
                if plane >= weights[0]:
                    parts.append((0, 0, "dc", (q[rows] > plane).astype(np.int64), own[:, 0] >> plane & 1))
                parts += plane_words(own, plane, weights)
                for stage, seq, kind, length, value in parts:
                    keep = length > 0
                    if keep.any():
                        yield _batch(batch, rows[keep], plane, stage, seq, kind, length[keep], pa.array(value[keep].astype(np.int64)), None)
                magnitude = np.abs(own[:, 1:])
                asked = (magnitude >> (plane + 1) > 0) & (np.array(weights)[_SUBBAND[1:]] <= plane)
                keep = asked.any(axis=1)
                if keep.any():
                    yield _batch(batch, rows[keep], plane, 4, 0, "refinement", asked[keep].sum(axis=1), None, _strings(asked[keep], (magnitude[keep] >> plane & 1).astype(np.uint8)))

    rows = segmented.join(stats.select(*KEY, "bdepth_ac", "q"), list(KEY)).where("bdepth_ac > 0")
    return rows.select(F.col("image_id").cast("string"), F.col("z").cast("int"), "segment_id", "b", "gaggle", F.col("bdepth_ac").cast("int"), F.col("q").cast("int"), "content").mapInArrow(run, WORDS)


def _batch(batch, rows, plane, stage, seq, kind, length, value, raw) -> pa.RecordBatch:
    n, at = len(rows), pa.array(rows)
    return pa.RecordBatch.from_arrays([
        *(batch.column(c).take(at) for c in range(5)),
        pa.array(np.full(n, plane, np.int32)), pa.array(np.full(n, stage, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array([kind] * n, pa.string()), pa.array(length.astype(np.int32)),
        pa.nulls(n, pa.int64()) if value is None else value, pa.nulls(n, pa.string()) if raw is None else raw,
    ], names=["image_id", "z", "segment_id", "b", "gaggle", "plane", "stage", "seq", "kind", "len", "val", "raw"])


def additional_dc(segmented: DataFrame, stats: DataFrame, weights: Sequence[int] = T.WEIGHTS) -> DataFrame:
    """DC bits below the quantisation and above all planes, plane by plane from the top."""
    rows = segmented.join(stats.select(*KEY, "bdepth_ac", "q"), list(KEY)).withColumn("least", F.greatest("bdepth_ac", F.lit(int(weights[0])))).where("q > least")
    rows = rows.select(*KEY, "b", F.element_at("content", 1).alias("dc"), F.explode(F.sequence(F.col("least").cast("int"), F.col("q") - 1)).alias("plane"))
    return rows.select(*KEY, "b", "plane", F.pmod(F.call_function("shiftright", "dc", F.col("plane")), B.big(2)).cast("int").alias("bit"))
