"""Folders of PNG frames as tables of pixel rows, and masks written as such folders.

png_frames is a data source of Spark: `path/<video>/<number>.png`, read in ranges of frames and written with a commit.  Its
tasks open files themselves, so the path must be one that all executors mount; where only Spark reaches the files, png_rows()
takes their bytes from files.frame_folder().
"""

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of each colour type of the format
SCHEMA = "video_id string, n long, y int, width int, channels int, pixels binary"
#: Frames of a partition.
RANGE = 64


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Bytes of the rows of an image; each row says by which filter it was written.  step: bytes of a pixel."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y, (kind, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):  # each byte needs the one before it
            now, up = bytearray(row.tobytes()), above.tobytes()
            for i in range(stride):
                a, b = (now[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i - step] if i >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                now[i] = (now[i] + guess) & 255
            row = np.frombuffer(bytes(now), np.uint8)
        elif kind:
            raise ValueError("a row filter that PNG doesn't have")
        out[y] = above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of pixels of channels, 8 bits each; a palette's colours stand for its indexes.  Raises ValueError for what is no PNG of
    8 bits, whole and not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not a PNG of 8 bits without interlacing")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError("a PNG that is not whole") from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("a PNG of another size than it says")
    pixels = _unfilter(raw, height, width * channels, channels).reshape(height, width, channels)
    return palette[pixels[..., 0]] if head[3] == 3 else pixels


def encode_png(pixels: np.ndarray) -> bytes:
    """pixels (rows, columns, 1 to 4 channels) as a PNG whose rows hold differences from the row above."""
    height, width, channels = pixels.shape
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(height, width * channels)
    body = np.column_stack([np.full(height, 2, np.uint8), np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))])
    colour = {n: t for t, n in CHANNELS.items() if t != 3}[channels]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body.tobytes())) + chunk(b"IEND", b"")


def _rows(video: str, n: int, data: bytes) -> Iterator[tuple]:
    pixels = decode_png(data)
    for y in range(pixels.shape[0]):
        yield video, n, y, pixels.shape[1], pixels.shape[2], pixels[y].tobytes()


@dataclass
class Frames(InputPartition):
    """A range of the frames of a video: (number, path)."""

    video: str
    files: list


@dataclass
class Written(WriterCommitMessage):
    """Files of a task under the names that they wait under and those that they get."""

    files: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Frames]:
        out = []
        for video in sorted(e.name for e in os.scandir(self.path) if e.is_dir()):
            folder = os.path.join(self.path, video)
            files = sorted((int(f[:-4]), os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".png") and f[:-4].isdigit())
            out += [Frames(video, files[i : i + self.size]) for i in range(0, len(files), self.size)]
        return out

    def read(self, partition: Frames) -> Iterator[tuple]:
        for n, name in partition.files:
            with open(name, "rb") as f:
                yield from _rows(partition.video, n, f.read())


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        """Each image's rows follow one another, by y."""
        files, key, held = [], None, []

        def close() -> None:
            if held:
                folder = os.path.join(self.path, key[0])
                os.makedirs(folder, exist_ok=True)
                waiting = os.path.join(folder, f".{uuid.uuid4().hex}")
                files.append((waiting, os.path.join(folder, f"{key[1]}.png")))
                with open(waiting, "wb") as f:
                    f.write(encode_png(np.stack([np.frombuffer(p, np.uint8).reshape(w, c) for w, c, p in held])))

        try:
            for r in rows:
                if (r["video_id"], r["n"]) != key:
                    close()
                    key, held = (r["video_id"], r["n"]), []
                held.append((r["width"], r["channels"], bytes(r["pixels"])))
            close()
        except BaseException:
            self.abort([Written(files)])
            raise
        return Written(files)

    def commit(self, messages) -> None:
        for m in messages:
            for waiting, name in m.files if m else ():
                os.replace(waiting, name)

    def abort(self, messages) -> None:
        for m in messages:
            for waiting, _ in m.files if m else ():
                if os.path.exists(waiting):
                    os.remove(waiting)


class PngFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("framesPerPartition", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_frames(spark: SparkSession, path: str, frames: int = RANGE) -> DataFrame:
    """SCHEMA: the pixel rows of all frames under a path that executors mount, so many frames a partition."""
    spark.dataSource.register(PngFrames)
    return spark.read.format("png_frames").option("framesPerPartition", frames).load(path)


def png_rows(files: DataFrame) -> DataFrame:
    """files(video_id, n, content) -> SCHEMA; a content that is null or no such PNG has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for video, n, data in zip(batch["video_id"], batch["n"], batch["content"]):
                try:
                    made = list(_rows(video, n, bytes(data))) if data is not None else []
                except ValueError:
                    made = []
                yield pd.DataFrame(made, columns=names)

    return files.select("video_id", "n", "content").mapInPandas(run, SCHEMA)


def to_pixels(rows: DataFrame, names: str = "rgb") -> DataFrame:
    """rows(video_id, n, y, width, channels, pixels) -> video_id, n, y, x and a column of each channel; images of one channel have
    its value in all of them."""
    cells = rows.select("video_id", "n", F.col("y").cast("long").alias("y"), "channels", F.hex("pixels").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    at = lambda k: F.col("x") * F.col("channels") + F.least(F.lit(k), F.col("channels") - 1)
    value = lambda k: F.conv(F.substring("h", (at(k) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    return cells.select("video_id", "n", "y", F.col("x").cast("long").alias("x"), *[value(k).alias(c) for k, c in enumerate(names)])


def write_masks(pixels: DataFrame, path: str) -> None:
    """pixels(video_id, n, y, x, v: 0 to 255) as PNG files of one channel.  All files of the table appear when all its tasks are
    done; if one fails none does."""
    pixels.sparkSession.dataSource.register(PngFrames)
    line = F.sort_array(F.collect_list(F.struct("x", F.lpad(F.hex(F.col("v").cast("long")), 2, "0").alias("b"))))
    rows = pixels.groupBy("video_id", "n", "y").agg(F.unhex(F.array_join(F.transform(line, lambda c: c["b"]), "")).alias("pixels"), F.count("*").cast("int").alias("width"))
    rows = rows.select(F.col("video_id").cast("string").alias("video_id"), F.col("n").cast("long").alias("n"), F.col("y").cast("int").alias("y"), "width", F.lit(1).alias("channels"), "pixels")
    rows.repartition("video_id", "n").sortWithinPartitions("video_id", "n", "y").write.format("png_frames").mode("append").save(path)
