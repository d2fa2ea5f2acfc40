"""Command line and streaming."""

from pyspark.sql import functions as F

from bitweave.__main__ import main
from bitweave.functions import tables as T
from bitweave.operators import segments, tiles
from bitweave.sources import raster
from bitweave.streaming.restore import decoded_stream


def test_command_line_and_stream(spark, tmp_path):
    out = tmp_path / "segments"
    assert main(["compress", "--generate", "24", "40", "--size", "16", "--dst", f"file://{out}"]) == 0
    assert main(["restore", "--path", str(out), "--dst", str(tmp_path / "pixels")]) == 0
    image = raster.generate(spark, 24, 40)
    back = spark.read.parquet(str(tmp_path / "pixels"))
    assert back.exceptAll(image).isEmpty() and back.count() == image.count()
    query = decoded_stream(spark, str(out), size=16).writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = segments.cut(tiles.to_blocks(raster.padded(image), raster.meta(image), T.WEIGHTS), 16)
    got = spark.table("blocks")
    assert got.count() == 15 and want.join(got.withColumnRenamed("content", "other"), ["segment_id", "b"]).where(F.col("content") != F.col("other")).isEmpty()


def test_command_line_tells_errors(capsys):
    assert main(["compress", "--dwt", "fp", "--dst", "/nowhere"]) == 2
    said = capsys.readouterr().err
    assert "integer wavelet" in said and "exactly one" in said


def test_command_line_settings(spark, tmp_path, capsys):
    out, wide = str(tmp_path / "s"), ["--generate", "40", "48", "--size", "16"]
    assert main(["compress", *wide, "--at", "1:segment_size=10", "--dst", out]) == 2 and "16 to" in capsys.readouterr().err
    assert main(["compress", *wide, "--at", "1:segment_size=20,heuristic_dc", "--id", "named", "--dst", f"file://{out}"]) == 0
    assert main(["restore", "--path", out, "--strict", "--report", "--transpose", "yes", "--dst", str(tmp_path / "p")]) == 0
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 40 * 48 and {r.image_id for r in back.select("image_id").distinct().collect()} == {"named"} and back.agg(F.max("y")).collect()[0][0] == 39
    assert main(["restore", "--path", f"{out}/*segment_1*", "--strict", "--report", "--dst", str(tmp_path / "q")]) == 2
    assert "gap" in capsys.readouterr().err
