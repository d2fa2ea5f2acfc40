"""The three-level wavelet of large images, tile by tile, with one shuffle.

A tile and a border of 32 pixels around it hold all that the tile's
coefficients depend on (28 pixels over three levels). So every pixel goes to
its tile and, near an edge, to the neighbours; a tile is a bounded group
however large the image is, and is transformed as a matrix. What an Arrow batch
has for a tile goes there as one row of packed places and values, so no pixel
is shuffled as a row. Tile sides are multiples of eight, so a tile's
coefficients make whole blocks of 64, and the blocks leave the task assembled.
The inverse deals blocks to tiles likewise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitweave.functions import tables as T

TILE, HALO = 256, 32
BLOCKS = "image_id string, z int, blk bigint, content array<bigint>"
_PLACES = [T.place(i)[:4] for i in range(T.BLOCK)]


def _shift(a: np.ndarray, n: int, before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray:
    """The neighbour n places on, along the last axis; the ends are given."""
    return np.concatenate([a[..., n:], after] if n > 0 else [before, a[..., :n]], axis=-1)


def _prediction(e: np.ndarray) -> np.ndarray:
    """What even samples predict for the odd ones, with mirrored ends."""
    last, second = e[..., -1:], e[..., -2:-1] if e.shape[-1] > 1 else e[..., -1:]
    first = e[..., 1:2] if e.shape[-1] > 1 else e[..., :1]
    right = _shift(e, 1, None, last)
    beyond = _shift(right, 1, None, second)
    left = _shift(e, -1, first, None)
    return e + right + (e + right - left - beyond >> 3) + 1 >> 1


def _correction(h: np.ndarray) -> np.ndarray:
    return 2 - _shift(h, -1, h[..., :1], None) - h >> 2


def forward_lines(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low-pass, high-pass) of lines of even length along the last axis."""
    h = a[..., 1::2] - _prediction(a[..., 0::2])
    return a[..., 0::2] - _correction(h), h


def inverse_lines(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.empty((*low.shape[:-1], low.shape[-1] * 2), dtype=np.int64)
    out[..., 0::2] = low + _correction(high)
    out[..., 1::2] = high + _prediction(out[..., 0::2])
    return out


def forward_image(a: np.ndarray) -> list[np.ndarray]:
    """The ten subbands of a matrix with sides of multiples of eight."""
    out = []
    for _ in range(3):
        low, high = forward_lines(a)
        (ll, lh), (hl, hh) = ((x.swapaxes(0, 1) for x in forward_lines(k.swapaxes(0, 1))) for k in (low, high))
        out = [hl, lh, hh, *out]
        a = ll
    return [a, *out]


def inverse_image(bands: list[np.ndarray]) -> np.ndarray:
    a = bands[0]
    for level in range(3):
        hl, lh, hh = bands[1 + 3 * level : 4 + 3 * level]
        join = lambda x, y: inverse_lines(x.swapaxes(0, 1), y.swapaxes(0, 1)).swapaxes(0, 1)
        a = inverse_lines(join(a, lh), join(hl, hh))
    return a


def _touched(at: str, side: int, halo: int, size: str):
    """The tiles of one axis that a place belongs to or borders on."""
    last = F.floor((F.col(size) - 1) / side)
    return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - halo) / side), F.lit(0)), F.least(F.floor((F.col(at) + halo) / side), last)))


def _spread(at: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a place, tile) for all tiles of one axis that each place belongs to or borders on; the last may lie behind the image."""
    low = np.maximum((at - HALO) // tile, 0)
    n = (at + HALO) // tile - low + 1
    rows = np.repeat(np.arange(len(at)), n)
    return rows, low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)


def packed(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels by tile: image_id, z, ty, tx, and packed places in the tile with its border (at) and values (v)."""
    side = tile + 2 * HALO

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            z, y, x, v = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 5))
            rows, ty = _spread(y, tile)
            again, tx = _spread(x[rows], tile)
            rows, ty = rows[again], ty[again]
            keys = tx, ty, z[rows], names.indices.to_numpy()[rows]
            order = np.lexsort(keys)
            keys, rows = [k[order] for k in keys], rows[order]
            begin = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
            at = (y[rows] - keys[1] * tile + HALO) * side + x[rows] - keys[0] * tile + HALO
            ends = np.append(begin, len(rows))
            binary = lambda a: pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((ends * a.itemsize).astype(np.int32).tobytes()), pa.py_buffer(a.tobytes())])
            tx, ty, z, name = (k[begin] for k in keys)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(name)), pa.array(z.astype(np.int32)), pa.array(ty), pa.array(tx), binary(at.astype(np.int32)), binary(v[rows])], names=["image_id", "z", "ty", "tx", "at", "v"])

    own = pixels.where("image_id is not null").select(F.col("image_id").cast("string"), "z", "y", "x", "v")
    return own.mapInArrow(run, "image_id string, z int, ty bigint, tx bigint, at binary, v binary")


def to_blocks(pixels: DataFrame, sizes: DataFrame, weights: Sequence[int] = T.WEIGHTS, tile: int = TILE) -> DataFrame:
    """Blocks of scaled coefficients; sizes: image_id, width, height, padded_width, padded_height, as of raster.meta.

    Images are padded in their tiles: the last column and the last row are
    repeated, as raster.padded does. Padded pixels may be there already.
    """
    dealt = packed(pixels, tile).join(sizes.select("image_id", F.col("padded_width").alias("w"), F.col("padded_height").alias("h"), "width", "height"), "image_id")
    dealt = dealt.where((F.col("ty") * tile < F.col("h")) & (F.col("tx") * tile < F.col("w")))
    weights, side = [int(w) for w in weights], tile + 2 * HALO

    def run(table: pa.Table) -> pa.Table:
        w, h, ty, tx, z, width, height = (table.column(c)[0].as_py() for c in ("w", "h", "ty", "tx", "z", "width", "height"))
        y0, x0 = max(ty * tile - HALO, 0), max(tx * tile - HALO, 0)
        y1, x1 = min((ty + 1) * tile + HALO, h), min((tx + 1) * tile + HALO, w)
        a = np.zeros((y1 - y0, x1 - x0), dtype=np.int64)
        at, v = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("at", np.int32), ("v", np.int64)))
        y, x = at // side + ty * tile - HALO, at % side + tx * tile - HALO
        inside = (y < y1) & (x < x1)
        a[y[inside] - y0, x[inside] - x0] = v[inside]
        # a border ends at a multiple of eight, so what reaches into the padding has the last column or row as well
        if x1 > width:
            a[:, width - x0 :] = a[:, width - x0 - 1, None]
        if y1 > height:
            a[height - y0 :] = a[height - y0 - 1]
        bands = [b << weights[k] for k, b in enumerate(forward_image(a))]
        rows, cols = (min((ty + 1) * tile, h) - ty * tile) // 8, (min((tx + 1) * tile, w) - tx * tile) // 8
        by, bx = (ty * tile - y0) // 8, (tx * tile - x0) // 8
        content = np.empty((rows, cols, T.BLOCK), dtype=np.int64)
        for i, (sb, s, r, c) in enumerate(_PLACES):
            content[:, :, i] = bands[sb][by * s + r : (by + rows) * s : s, bx * s + c : (bx + cols) * s : s][:rows, :cols]
        blk = (ty * tile // 8 + np.arange(rows))[:, None] * (w // 8) + tx * tile // 8 + np.arange(cols)
        n = rows * cols
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * T.BLOCK + 1, T.BLOCK), pa.int32()), pa.array(content.ravel()))
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()] * n, pa.string()), "z": pa.array(np.full(n, z, np.int32)), "blk": pa.array(blk.ravel()), "content": lists})

    return dealt.groupBy("image_id", "z", "ty", "tx").applyInArrow(run, BLOCKS)


def to_pixels(blocks: DataFrame, sizes: DataFrame, weights: Sequence[int] = T.WEIGHTS, tile: int = TILE) -> DataFrame:
    """Padded images from their blocks; sizes: image_id, padded_width, padded_height. weights may be a column of sizes."""
    own = [F.col("weights")] if "weights" in sizes.columns else [F.array(*(F.lit(int(w)) for w in weights)).alias("weights")]
    rows = blocks.join(sizes.select("image_id", F.col("padded_width").alias("w"), F.col("padded_height").alias("h"), *own), "image_id")
    rows = rows.withColumn("y", F.expr("blk div (w div 8) * 8")).withColumn("x", F.expr("blk % (w div 8) * 8"))
    dealt = rows.withColumn("ty", _touched("y", tile, HALO, "h")).withColumn("tx", _touched("x", tile, HALO, "w"))

    def run(table: pa.Table) -> pa.Table:
        w, h, ty, tx, z, scale = (table.column(c)[0].as_py() for c in ("w", "h", "ty", "tx", "z", "weights"))
        y0, x0 = max(ty * tile - HALO, 0), max(tx * tile - HALO, 0)
        rows, cols = (min((ty + 1) * tile + HALO, h) - y0) // 8, (min((tx + 1) * tile + HALO, w) - x0) // 8
        y, x = (table.column("y").to_numpy() - y0) // 8, (table.column("x").to_numpy() - x0) // 8
        content = table.column("content").combine_chunks()
        content = (content.chunk(0) if isinstance(content, pa.ChunkedArray) else content).flatten().to_numpy().reshape(-1, T.BLOCK)
        inside = (y < rows) & (x < cols)
        y, x, content = y[inside], x[inside], content[inside]
        bands = [np.zeros((rows << k, cols << k), dtype=np.int64) for k in (0, 0, 0, 0, 1, 1, 1, 2, 2, 2)]
        for i, (sb, s, r, c) in enumerate(_PLACES):
            bands[sb][y * s + r, x * s + c] = content[:, i] >> scale[sb]
        a = inverse_image(bands)
        ys, xs = np.arange(ty * tile, min((ty + 1) * tile, h)), np.arange(tx * tile, min((tx + 1) * tile, w))
        a = a[ys[0] - y0 :, xs[0] - x0 :][: len(ys), : len(xs)]
        n = a.size
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()] * n, pa.string()), "z": pa.array(np.full(n, z, np.int32)), "y": pa.array(np.repeat(ys, len(xs))), "x": pa.array(np.tile(xs, len(ys))), "v": pa.array(a.ravel())})

    return dealt.groupBy("image_id", "z", "ty", "tx").applyInArrow(run, "image_id string, z int, y bigint, x bigint, v bigint")
