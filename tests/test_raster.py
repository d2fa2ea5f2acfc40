"""The raster engine against plain Python formulas and by round trips."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitweave.functions import tables as T
from bitweave.operators import decode, entropy, protocol, rice, segments, settings, tiles, wavelet, words
from bitweave.plans import codec, queries
from bitweave.sources import files, raster, registry, scratch


def lines(x):
    """(low-pass, high-pass) of one line, by the definition with mirrored indices."""
    n = len(x)
    at = lambda i: x[-i if i < 0 else 2 * (n - 1) - i if i >= n else i]
    high = []
    for j in range(n // 2):
        pair = at(2 * j) + at(2 * j + 2)
        high.append(at(2 * j + 1) - ((pair + ((pair - at(2 * j - 2) - at(2 * j + 4)) >> 3) + 1) >> 1))
    return [x[2 * j] - ((2 - high[max(j - 1, 0)] - high[j]) >> 2) for j in range(n // 2)], high


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("n", [6, 8, 24, 100])
def test_one_line(spark, n):
    rng = random.Random(n)
    x = [rng.randrange(-5000, 5000) for _ in range(n)]
    samples = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "l int, p long, v long")
    coeffs = wavelet.forward_1d(samples, ["l"], "p")
    low, high = lines(x)
    assert {(r.high, r.at): r.v for r in coeffs.collect()} == {(0, i): v for i, v in enumerate(low)} | {(1, i): v for i, v in enumerate(high)}
    assert [r.v for r in wavelet.inverse_1d(coeffs, ["l"], "high", "at").orderBy("pos").collect()] == x


@pytest.mark.parametrize(("width", "height"), [(17, 17), (33, 20)])
def test_windows_agree_with_tiles(spark, width, height):
    pixels = raster.generate(spark, width, height)
    meta = raster.meta(pixels)
    padded = raster.padded(pixels)
    coeffs = wavelet.scaled(wavelet.forward(padded))
    by_window = segments.blocks(coeffs, meta).select("blk", "content")
    by_tile = tiles.to_blocks(padded, meta, tile=16).select("blk", "content")
    assert same(by_window, by_tile)
    assert same(raster.trimmed(wavelet.inverse(wavelet.unscaled(coeffs)), width, height), pixels)


CASES = {
    "default": (40, 23, 12, T.WEIGHTS, 16, {}),
    "weights": (64, 48, 10, (2, 3, 1, 0, 2, 2, 3, 1, 3, 0), 17, {}),
    "sparse": (24, 24, 4, (0,) * 10, 16, {}),
    "heuristic": (24, 40, 16, T.WEIGHTS, 20, {"heuristic_dc": True, "heuristic_ac": True}),
    "compat": (48, 48, 12, T.WEIGHTS, 36, {"compat": True}),
}


@pytest.mark.parametrize("name", CASES)
def test_segments_decode_to_their_blocks(spark, name):
    width, height, depth, weights, size, options = CASES[name]
    pixels = raster.generate(spark, width, height, bdepth=depth)
    cut = segments.cut(tiles.to_blocks(raster.padded(pixels), raster.meta(pixels), weights), size).cache()
    coded = entropy.segment_bits(cut, weights, entropy.Rules(**options)).withColumnRenamed("bits", "data")
    back = decode.decoded(coded, weights, wide_dc=options.get("compat", False))
    assert same(cut.select("segment_id", "b", "content"), back.select("segment_id", "b", "content"))


def test_flat_image(spark):
    pixels = raster.generate(spark, 24, 24).withColumn("v", F.lit(-3).cast("bigint"))
    assert same(codec.restore(codec.compress(pixels, codec.Settings(segment_size=16))), pixels)


def test_files_round_trip(spark, tmp_path):
    pixels = raster.generate(spark, 33, 41, channels=2)
    options = codec.Settings(segment_size=16, weights=(2, 3, 1, 0, 2, 2, 3, 1, 3, 0), transpose=True, codeword=32)
    written = files.write_segments(codec.compress(pixels, options), f"file://{tmp_path}/out").collect()
    read = files.read_segments(spark, f"{tmp_path}/out")
    assert read.count() == len(written) == 4
    assert same(codec.restore(read), pixels)
    heads = protocol.parsed(read).orderBy("z", "segment_id").collect()
    assert all(h.marker == 0x5E and h.declared_bytes == len(h.content) - h.offset for h in heads)
    assert codec.sequence_gaps(read).isEmpty()
    assert codec.sequence_gaps(read.where("segment_id > 0")).count() == 2


def test_byte_limit_leaves_a_prefix(spark):
    pixels = raster.generate(spark, 32, 32)
    cut = codec.compress(pixels, codec.Settings(segment_size=16, byte_limit=200))
    assert cut.agg(F.max("n_bytes")).collect()[0][0] <= 200 + 12
    whole = {(r.y, r.x): r.v for r in pixels.collect()}
    near = {(r.y, r.x): r.v for r in codec.restore(cut).collect()}
    assert near.keys() == whole.keys()
    assert sum(abs(near[k] - whole[k]) for k in whole) / len(whole) < 600


def test_k_is_the_best_of_all(spark):
    rng = random.Random(3)
    rows = [("i", 0, s, b, b // 16, 8, rng.randrange(-100, 100), None if b == 0 else rng.randrange(rng.choice([2, 9, 60, 250]))) for s in range(4) for b in range(40)]
    table = spark.createDataFrame(rows, "image_id string, z int, segment_id long, b long, gaggle long, dc_n int, dc_q long, dc_delta long")
    for r in rice.chosen(table, "dc").collect():
        size = {k: sum((d >> k) + 1 + k for d in r.d) for k in range(7)}
        best = min(size, key=lambda k: (size[k], k))
        assert r.k == (-1 if size[best] >= 8 * len(r.d) else best)


def test_folding_is_one_to_one():
    for n in (2, 4, 6):
        low, high = -(1 << (n - 1)), (1 << (n - 1)) - 1
        for p in range(low, high + 1):
            folded = [decode._unfolded([p, d], low, high)[1] for d in range(1 << n)]
            assert sorted(folded) == list(range(low, high + 1))


def test_settings(spark):
    sparse = spark.createDataFrame([(0, 5), (3, 5), (3, 5), (7, 9)], "from_segment long, size int")
    assert [tuple(r) for r in settings.deduplicated(sparse).orderBy("from_segment").collect()] == [(0, 5), (7, 9)]
    numbers = spark.range(10).withColumnRenamed("id", "segment_id")
    few = settings.as_of(numbers, sparse.dropDuplicates()).orderBy("segment_id").select("segment_id", "from_segment", "size", "strict").collect()
    for bucket in (1, 2, 5):
        assert few == settings.as_of(numbers, sparse.dropDuplicates(), bucket=bucket).orderBy("segment_id").select("segment_id", "from_segment", "size", "strict").collect()
    assert [r.size for r in few] == [5] * 7 + [9] * 3 and [r.segment_id for r in few if r.strict] == [0, 3, 7]


def test_codewords():
    assert [protocol.codeword_bits(protocol.codeword_code(n)) for n in range(8, 65, 8)] == list(range(8, 65, 8))
    with pytest.raises(ValueError):
        protocol.codeword_code(12)


def test_bad_settings():
    with pytest.raises(codec.InvalidSettings, match="blocks.*weights"):
        codec.Settings(segment_size=3, weights=(4,) * 10).checked()


def test_quantisation_over_all_depths(spark):
    """The column form and the number form of the rule, and what it promises."""
    pairs = spark.range(1, 32).withColumnRenamed("id", "dc").crossJoin(spark.range(0, 32).withColumnRenamed("id", "ac"))
    rows = pairs.select("dc", "ac", *(segments.quantisation(F.col("dc").cast("int"), F.col("ac").cast("int"), w).alias(f"q{w}") for w in range(4))).collect()
    assert len(rows) == 31 * 32
    for r in rows:
        for w in range(4):
            assert r[f"q{w}"] == entropy.quantised(r.dc, r.ac, w) >= w
        assert r.q0 == 0 if r.dc <= 3 else 2 <= r.dc - r.q0 <= 10


def test_codes_are_prefix_free():
    for (n, _), codes in T.CODES.items():
        codes = codes.split(" ")
        assert len(codes) == 1 << n and sum(2.0 ** -len(c) for c in codes) <= 1
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    for (n, kind), symbols in T.SYMBOLS.items():
        used = sorted(s for s in symbols if s >= 0)
        assert len(symbols) == 1 << n and used == list(range(len(used))), kind


def test_stretches_of_a_segment(monkeypatch):
    """A segment's bits don't depend on how many blocks are held at a time."""
    rng = np.random.default_rng(3)
    content = np.round(rng.laplace(0, 40, (200, 64))).astype(np.int64) >> 3 << 3
    segment = entropy.Segment(content, T.WEIGHTS)
    whole = entropy.encode(segment)
    monkeypatch.setattr(entropy, "STRETCH", 32)
    apart = entropy.encode(segment)
    assert (whole.n, whole.bytes()) == (apart.n, apart.bytes())
    assert (decode.decode_segment(whole.bytes(), 200, segment.bdepth_dc, segment.bdepth_ac) == content).all()


@pytest.mark.parametrize("left_out", entropy.PARTS[2:])
def test_parts_of_a_stream(left_out):
    """A stream without a part is read back without it, and a code that can't be there is an error or the end."""
    rng = np.random.default_rng(4)
    content = np.round(rng.laplace(0, 30, (40, 64))).astype(np.int64) >> 3 << 3
    segment = entropy.Segment(content, T.WEIGHTS)
    parts = tuple(p for p in entropy.PARTS if p != left_out)
    bits = entropy.encode(segment, entropy.Rules(parts=parts))
    assert bits.n < entropy.encode(segment).n
    if left_out == "bdepth_ac":
        assert (decode.decode_segment(bits.bytes(), 40, segment.bdepth_dc, segment.bdepth_ac, parts=parts) == content).all()
    if left_out == "stage_0":
        assert (decode.decode_segment(bits.bytes(), 40, segment.bdepth_dc, segment.bdepth_ac, parts=parts)[:, 1:] == content[:, 1:]).all()


def test_early_stops_agree():
    """Reading a whole stream up to a stop gives what a stream that stops there holds."""
    rng = np.random.default_rng(5)
    content = np.round(rng.laplace(0, 30, (40, 64))).astype(np.int64) >> 3 << 3
    segment = entropy.Segment(content, T.WEIGHTS)
    depths = segment.bdepth_dc, segment.bdepth_ac
    whole = entropy.encode(segment).bytes()
    for plane, stage in ((0, 4), (2, 1), (3, 4), (4, 2), (4, 0)):
        short = entropy.encode(segment, entropy.Rules(stop_plane=plane, stop_stage=stage)).bytes()
        assert (decode.decode_segment(whole, 40, *depths, stop_plane=plane, stop_stage=stage) == decode.decode_segment(short, 40, *depths, stop_plane=plane, stop_stage=stage)).all()
    only = entropy.encode(segment, entropy.Rules(dc_only=True)).bytes()
    assert (decode.decode_segment(whole, 40, *depths, dc_only=True) == decode.decode_segment(only, 40, *depths, dc_only=True)).all()


def test_settings_by_segment(spark):
    """Sizes, limits and flags that change with segments, from a table or pairs; repeats are no change."""
    pixels = raster.generate(spark, 72, 80, channels=2)
    changes = [(1, {"segment_size": 20}), (2, {"segment_size": 20}), (3, {"segment_size": 33, "heuristic_dc": True}), (4, {"use_fill": True, "byte_limit": 9000})]
    files_ = codec.compress(pixels, codec.Settings(segment_size=16), changes).cache()
    sizes = [16, 20, 20, 33, 1]
    assert [(r.z, r.segment_id, r.size) for r in files_.orderBy("z", "segment_id").collect()] == [(z, i, n) for z in range(2) for i, n in enumerate(sizes)]
    assert {r.n_bytes for r in files_.where("segment_id = 4").collect()} == {9000 + 32 - heads(files_, 4)}
    assert same(codec.restore(files_, strict=True), pixels)
    assert same(codec.restore(files_.where("segment_id <> 2").unionByName(files_.where("segment_id = 2"))), pixels)
    table = spark.createDataFrame([(1, 20, None), (3, 33, True)], "from_segment long, segment_size int, heuristic_dc boolean")
    assert codec.Timeline(codec.Settings(segment_size=16), table).spans == codec.Timeline(codec.Settings(segment_size=16), changes[:3]).spans
    # a lost segment leaves its own blocks at zero and the others in their places
    left = {(r.z, r.y, r.x): r.v for r in codec.restore(files_.where("segment_id <> 2")).collect()}
    right = {(r.z, r.y, r.x): r.v for r in pixels.collect()}
    assert left.keys() == right.keys() and sum(left[k] == v for k, v in right.items()) > len(right) / 3
    assert codec.restore(files_.where("segment_id <> 1")).count() == pixels.count()  # the settings of those behind it are lost as well
    with pytest.raises(codec.InvalidSettings, match="weights"):
        codec.compress(pixels, codec.Settings(), [(1, {"weights": (0,) * 10})])
    with pytest.raises(codec.InvalidSettings, match="blocks"):
        codec.compress(pixels, codec.Settings(), [(1, {"segment_size": 3})])


def heads(files_, segment):
    return 32 - protocol.parsed(files_.where(F.col("segment_id") == segment)).collect()[0].offset


def test_problems_of_files(spark):
    pixels = raster.generate(spark, 40, 48, channels=2)
    good = codec.compress(pixels, codec.Settings(segment_size=16)).cache()
    assert protocol.problems(protocol.parsed(good)).isEmpty()

    def found(df):
        return {(r.z, r.segment_id, r.problem) for r in protocol.problems(protocol.parsed(df)).collect()}

    assert found(good.where("z = 0 or segment_id < 1")) == {(1, 0, "last"), (None, None, "channels")}
    assert found(good.where("z = 0 or segment_id > 0")) == {(1, 1, "first"), (1, 1, "gap"), (None, None, "channels")}
    short = good.withColumn("content", F.when(F.col("segment_id") == 1, F.expr("substring(content, 1, 50)")).otherwise(F.col("content")))
    assert found(short) == {(0, 1, "truncated"), (1, 1, "truncated")}
    with pytest.raises(codec.HeaderError, match="channel 0 segment 1: truncated"):
        codec.restore(short, strict=True)
    junk = good.withColumn("content", F.when((F.col("segment_id") == 1) & (F.col("z") == 1), F.lit(b"no segment file at all, but something else")).otherwise(F.col("content")))
    assert (1, 1, "marker") in found(junk)
    back = codec.restore(junk)
    assert back.count() == pixels.count() and same(back.where("z = 0"), pixels.where("z = 0"))


def test_bare_segments_and_overrides(spark):
    pixels = raster.generate(spark, 33, 24)
    options = codec.Settings(segment_size=16, transpose=True)
    bare = codec.compress(pixels, codec.Settings(segment_size=16, transpose=True, protocol="memory"))
    whole = codec.compress(pixels, options)
    joined = bare.join(whole.select("segment_id", F.col("content").alias("file")), "segment_id")
    assert joined.where(F.expr("substring(file, 33 - (length(file) - 32 - (length(file) - length(content))) * 0 - (length(content) - (length(file) - 32)), length(content))") != F.col("content")).isEmpty()
    assert same(codec.restore(bare, protocol_="memory", strict=True), pixels)
    turned = codec.restore(whole, transpose=False)
    assert same(raster.transposed(turned), pixels)
    error = lambda **stop: sum(abs(r.d) for r in codec.restore(whole, **stop).join(pixels.withColumnRenamed("v", "w"), ["image_id", "z", "y", "x"]).select((F.col("v") - F.col("w")).alias("d")).collect())
    assert 0 == error() < error(stop_plane=5) < error(dc_only=True)
    assert error(byte_limit=200) > 0


def test_steps_and_registry(spark, tmp_path):
    pixels = registry.read(spark, "noise", width=24, height=32)
    steps = codec.stages(pixels, codec.Settings(segment_size=16))
    assert list(steps) == ["pixels", "meta", "blocks", "segments", "bits", "files"] and steps["blocks"].count() == 12 and steps["bits"].count() == 1
    registry.write(pixels, "table", path=str(tmp_path / "t"))
    registry.write(steps["files"], "memory", view="files")
    assert registry.names(spark) == ["files"] and registry.get(spark, "files").count() == 1
    assert same(registry.read(spark, "table", path=str(tmp_path / "t")), pixels)
    assert registry.drop(spark, "files") and not registry.drop(spark, "files") and registry.names(spark) == []
    with pytest.raises(KeyError, match="noise"):
        registry.read(spark, "nothing")


def test_scope_removes_what_it_stored(spark):
    with scratch.scope(spark):
        kept = scratch.stored(spark.range(5), "scoped")
        path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_listing(spark, tmp_path):
    """Patterns, numbers in order, limits, and files cut off after so many bytes."""
    pixels = raster.generate(spark, 64, 200)
    out = f"{tmp_path}/out"
    files.write_segments(codec.compress(pixels, codec.Settings(segment_size=16)), f"file://{out}", byte_limit=100).collect()
    read = files.read_segments(spark, f"{out}/*_segment_1*_0.ccsds")
    assert sorted(r.segment_id for r in read.collect()) == [1, 10, 11, 12] and read.agg(F.max(F.length("content"))).collect()[0][0] == 100
    assert [r.segment_id for r in files.read_segments(spark, out, limit=3).collect()] == [0, 1, 2]


def counted(spark, rows):
    """rows, and an accumulator of how many of them were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema), made


def test_pixels_travel_packed(spark):
    """Pixels go to tiles in a row for each batch and tile, in any order, of images of any sides, padded there."""
    few = raster.generate(spark, 300, 290)
    rows = tiles.packed(few.repartition(1)).collect()
    assert len(rows) <= 4 * (300 * 290 // 10_000 + 1) and {(r.ty, r.tx) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    pixels = raster.generate(spark, 41, 27, channels=2).unionByName(raster.generate(spark, 24, 50, image_id="other")).orderBy(F.rand(3))
    meta = raster.meta(pixels)
    one = lambda name: segments.blocks(wavelet.scaled(wavelet.forward(raster.padded(pixels.where(F.col("image_id") == name)))), meta)
    right = one("noise").unionByName(one("other")).select("image_id", "z", "blk", "content")
    for side in (16, tiles.TILE):
        assert same(tiles.to_blocks(pixels, meta, tile=side), right)


def test_files_are_made_once_for_restoring(spark):
    pixels = raster.generate(spark, 40, 48, channels=2)
    files_, made = counted(spark, codec.compress(pixels, codec.Settings(segment_size=16), [(1, {"segment_size": 20})]))
    assert same(codec.restore(files_, strict=True), pixels)
    assert made.value == 4
    # a segment that is there twice gives its blocks from each file, without mixing both files' headers
    assert same(codec.restore(files_.unionByName(files_)).distinct(), pixels)


def test_files_are_made_once_for_their_problems(spark, sf_dir, monkeypatch):
    files_, made = counted(spark, codec.compress(raster.generate(spark, 40, 48), codec.Settings(segment_size=16)))
    assert protocol.problems(protocol.parsed(files_)).isEmpty() and made.value == 2
    held = queries._files(spark, sf_dir)
    files_, made = counted(spark, held)
    monkeypatch.setattr(queries, "_files", lambda *_: files_)
    assert queries.header_check(spark, sf_dir).count() == 4 and made.value == held.count()


def test_settings_roundtrip_makes_files_once(spark, sf_dir, monkeypatch):
    held = queries._changing(spark, sf_dir)
    files_, made = counted(spark, held)
    monkeypatch.setattr(queries, "_changing", lambda *_: files_)
    assert same(queries.settings_roundtrip(spark, sf_dir), queries.img_from_embeddings(spark, sf_dir)) and made.value == held.count()


def test_words_of_many_groups_at_once():
    """Asked bits along the last axis, of short and long groups in any number of axes, against plain loops."""
    rng = np.random.default_rng(6)
    for shape in ((5, 3, 4, 4), (7, 3, 4), (6, 1), (4, 14), (4, 15), (9, 63)):
        asked, bits = rng.random(shape) < 0.7, rng.random(shape) < 0.5
        asked[0], bits[0] = True, True
        lens, values = words.folded(asked, bits)
        assert lens.shape == values.shape == shape[:-1]
        for at in np.ndindex(shape[:-1]):
            own = "".join(str(int(b)) for a, b in zip(asked[at], bits[at], strict=True) if a)
            assert (lens[at], values[at]) == (len(own), int(own or "0", 2))
