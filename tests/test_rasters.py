"""PNG frames: every row filter, round trips through the source and the sink, and a task that fails."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.sources import files
from quadrille.sources import rasters as p


def filtered(pixels, kinds):
    """A PNG whose rows are written by the given filters, byte by byte as the format defines them."""
    high, wide, step = pixels.shape
    rows, body, above = pixels.reshape(high, -1).tolist(), bytearray(), [0] * (wide * step)
    for row, kind in zip(rows, kinds):
        body.append(kind)
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda x: abs(x - (a + b - c)))][kind]
            body.append((v - guess) % 256)
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(bytes(body))
    halves = chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:])
    return p.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)) + chunk(b"tEXt", b"k\0v") + halves + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_row_filters(channels):
    rng = np.random.default_rng(channels)
    pixels = rng.integers(0, 256, (15, 9, channels)).astype(np.uint8)
    assert (p.decode_png(filtered(pixels, [k % 5 for k in range(15)])) == pixels).all()
    assert (p.decode_png(p.encode_png(pixels)) == pixels).all()


def test_what_is_no_png():
    whole = p.encode_png(np.zeros((3, 3, 1), np.uint8))
    for bad in (b"", b"GIF89a", whole[:40], whole.replace(b"IHDR", b"IXDR"), whole[:24] + b"\x10" + whole[25:]):
        with pytest.raises(ValueError):
            p.decode_png(bad)


def masks(spark):
    rng = random.Random(3)
    cells = [(v, n, y, x, rng.choice([0, 255, 7])) for v in ("a", "b") for n in (0, 1, 130) for y in range(6) for x in range(5)]
    return cells, spark.createDataFrame(cells, "video_id string, n long, y long, x long, v long")


def test_masks_come_back(spark, tmp_path):
    cells, table = masks(spark)
    p.write_masks(table.repartition(5), str(tmp_path))
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file()) == sorted(f"{v}/{n}.png" for v in "ab" for n in (0, 1, 130))
    rows = p.read_frames(spark, str(tmp_path), frames=2)
    assert rows.rdd.getNumPartitions() == 4  # two ranges of each video
    for read in (rows, p.png_rows(files.frame_folder(spark, str(tmp_path)))):
        got = p.to_pixels(read, "v")
        assert sorted(map(tuple, got.collect())) == sorted(cells)
    assert p.png_rows(spark.createDataFrame([("a", 1, None), ("a", 2, b"x")], "video_id string, n long, content binary")).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    _, table = masks(spark)
    broken = table.withColumn("v", F.when((F.col("video_id") == "b") & (F.col("n") == 130), F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost|failed|Writing"):
        p.write_masks(broken, str(tmp_path))
    assert [f for f in tmp_path.rglob("*") if f.is_file()] == []
