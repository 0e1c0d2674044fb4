"""GIF media columns: payloads stored as GIF frames, and GIF files decoded to timed frames with colour histograms."""

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64  # samples a row, so a payload is whole rows
ROWS = 1024  # rows a frame at most
DELAY = 10  # hundredths of a second
LAST = 4095  # largest code of the format
LEVELS = 4  # histogram levels of each colour channel
#: Pixels of a canvas or an image, where the caller sets no other bound: a file that declares more has an error instead of frames.
MOST_PIXELS = 1 << 24
# For each pass of an interlaced image, its first row and the step between rows.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
GREY = bytes(v for v in range(256) for _ in range(3))
FRAMES = "array<struct<start_cs:int,delay_cs:int,x:int,y:int,width:int,height:int,histogram:array<long>>>"


def lzw_codes(samples: bytes) -> np.ndarray:
    """Codes of 8-bit samples: a clear code, greedy longest matches with a clear code when the table is full, an end code."""
    table: dict[int, int] = {}
    get, out = table.get, [256 << 8]  # codes are held eight bits higher, so that a sample can be put below them
    put, free, full = out.append, 258 << 8, LAST << 8
    held = samples[0] << 8
    for c in samples[1:]:
        found = get(held | c)
        if found:
            held = found
        else:
            put(held)
            table[held | c] = free
            held = c << 8
            if free == full:
                put(256 << 8)
                table.clear()
                free = 258 << 8
            else:
                free += 256
    put(held)
    put(257 << 8)
    return np.array(out, np.int64) >> 8


@functools.cache
def code_bits(size: int, n: int) -> np.ndarray:
    """Bits of the n first codes after a clear code: the decoder's table has an entry for each code but the first."""
    held = np.minimum((1 << size) + 2 + np.maximum(np.arange(n) - 1, 0), LAST)
    return np.maximum(size + 1, np.floor(np.log2(held)).astype(np.int64) + 1)


def places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[i] - 1 for each i, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def pack(streams: list[np.ndarray]) -> list[bytes]:
    """The bit stream of each array of codes for 8-bit samples, least significant bit first."""
    codes, sizes = np.concatenate(streams), np.array([len(s) for s in streams])
    head = np.zeros(len(codes) + 1, bool)
    head[np.cumsum(sizes)] = True
    head[0] = True
    head[1:] |= codes == 256
    head = np.flatnonzero(head[:-1])
    bits = code_bits(8, LAST)[places(np.diff(np.append(head, len(codes))))]
    ends = np.cumsum(sizes) - 1
    total = np.add.reduceat(bits, np.append(0, ends[:-1] + 1))
    n_bytes = -(-total // 8)
    at = np.cumsum(bits) - bits + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8 - (np.cumsum(total) - total), sizes)
    wide, byte = codes << (at & 7), at >> 3
    out = sum(np.bincount(byte + k, wide >> 8 * k & 255, int(n_bytes.sum()) + 2) for k in range(3)).astype(np.uint8)
    cuts = np.cumsum(n_bytes)
    return [out[b - n : b].tobytes() for b, n in zip(cuts.tolist(), n_bytes.tolist())]


def lzw_samples(streams: list[bytes], size: int, limits: list[int]) -> list[np.ndarray]:
    """At most limits[i] samples of each code stream of the same code size; an empty array where a code is not in the table.

    Each round reads a segment (what lies between clear codes) of every stream.  A code beyond the literals stands for an
    earlier code's string and one sample more.  So each string's last sample and the code of what precedes it are known at
    once, and all strings are written from their ends, one sample of each in a step.
    """
    clear = 1 << size
    lengths = np.array([len(s) for s in streams], np.int64)
    raw = np.concatenate([np.frombuffer(b"".join(streams), np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    end = np.cumsum(lengths) * 8
    bit = end - lengths * 8
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    got, wanted = np.zeros(len(streams), np.int64), np.array(limits, np.int64)
    going, cap = np.arange(len(streams)), 4096
    while len(going := going[(bit[going] + size < end[going]) & (got[going] < wanted[going])]):
        n = np.minimum((end[going] - bit[going]) // (size + 1), cap)
        nth, owner = places(n), np.repeat(np.arange(len(going)), n)
        table = code_bits(size, 1 << int(n.max() - 1).bit_length())
        bits = table[nth]
        at = (np.cumsum(table) - table)[nth] + bit[going][owner]
        byte = np.minimum(at >> 3, len(raw) - 3)
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << bits) - 1)
        first = np.cumsum(n) - n
        never = np.iinfo(np.int64).max
        whole = np.add.reduceat((at + bits <= end[going][owner]).astype(np.int64), first)
        mark = np.minimum.reduceat(np.where((codes == clear) | (codes == clear + 1), nth, never), first)
        stop = np.minimum(mark, whole)
        open_ = (mark > whole) & (whole == cap)  # no clear code so far: to be read again, further
        marked = mark < whole
        ended = ~open_ & (~marked | (codes[first + np.minimum(stop, n - 1)] == clear + 1))
        stop[open_] = 0
        bit[going] = np.where(open_, bit[going], bit[going] + np.cumsum(table)[np.minimum(stop, len(table) - 1)])
        codes = codes[nth < stop[owner]]
        n = stop
        if len(codes):
            nth, base = places(n), np.repeat(np.cumsum(n) - n, n)
            every = np.arange(len(codes))
            literal = codes < clear
            before = np.where(literal, every, base + codes - clear - 2)  # the code whose string this one extends
            wrong = np.unique(base[~literal & (before >= every)])
            before = np.minimum(before, every)
            literal |= before == every
            root, length = before, 1 - literal.astype(np.int64)
            while (further := length[root]).any():
                length, root = length + further, root[root]
            tail = np.where(literal, codes, codes[root[np.minimum(before + 1, len(codes) - 1)]])
            to = np.cumsum(length + 1) - 1
            out = np.empty(int(to[-1]) + 1, np.uint8)
            code = every
            while len(code):
                out[to] = tail[code]
                more = ~literal[code]
                code, to = before[code[more]], to[more] - 1
            sizes = np.bincount(np.repeat(np.arange(len(going)), n), length + 1, len(going)).astype(np.int64)
            cuts = np.cumsum(sizes)
            bad = np.isin(np.cumsum(n) - n, wrong) & (n > 0)
            for i, g in enumerate(going.tolist()):
                parts[g].append(out[cuts[i] - sizes[i] : cuts[i]])
            parts = [[] if g in set(going[bad].tolist()) else p for g, p in enumerate(parts)] if bad.any() else parts
            ended |= bad
            got[going] += sizes
        going = going[~ended]
        cap = cap * 4 if open_.any() else 4096
    return [np.concatenate([*p, np.zeros(0, np.uint8)])[:m] for p, m in zip(parts, limits)]


def blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes at most, and the empty one that ends them."""
    return b"".join(bytes([len(b)]) + b for b in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gifs(payloads: list[bytes], delay_cs: int = DELAY) -> list[bytes]:
    """A GIF of each payload's grey 8-bit samples, WIDTH a row and ROWS a frame at most."""
    step = WIDTH * ROWS
    cuts = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    codes = iter(pack([lzw_codes(part) for parts in cuts for part in parts]))
    control = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0"
    out = []
    for parts in cuts:
        head = b"GIF89a" + struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0) + GREY
        images = [control + b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(p) // WIDTH, 0) + b"\x08" + blocks(next(codes)) for p in parts]
        out.append(b"".join([head, *images, b"\x3b"]))
    return out


def parse_gif(data: bytes, most_pixels: int | None = MOST_PIXELS) -> tuple[tuple[int, int], list[dict]]:
    """Canvas size, and of each image: its place, times, disposal, transparent index, palette, code size and code stream."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if most_pixels is not None and wide * high > most_pixels:
        raise ValueError("a canvas of too many pixels")
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        found = np.zeros((256, 4), np.uint8)
        found[:, 3] = 255
        found[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return found

    def gather() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    common, images, start = palette(flags), [], 0
    plain = {"disposal": 0, "delay_cs": 0, "clear": None}
    control = plain
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            at += 2
            body = gather()
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = {"disposal": packed >> 2 & 7, "delay_cs": delay, "clear": index if packed & 1 else None}
        elif data[at] == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            if most_pixels is not None and w * h > most_pixels:
                raise ValueError("an image of too many pixels")
            own = palette(flags)
            colours = common if own is None else own
            if colours is None:
                raise ValueError("no palette")
            size = data[at]
            if not 1 < size < 9:
                raise ValueError("a code size that GIF doesn't have")
            at += 1
            images.append({"x": x, "y": y, "width": w, "height": h, "start_cs": start, "interlaced": bool(flags & 0x40), "palette": colours, "size": size, "codes": gather()} | control)
            start += control["delay_cs"]
            control = plain
        else:
            raise ValueError("an unknown block")
    return (high, wide), images


def draw(shape: tuple[int, int], images: list[dict], samples: list[np.ndarray]) -> Iterator[dict]:
    """Frames in order: start_cs, delay_cs, x, y, width, height (of the drawn part) and canvas, rows of RGBA as they show.
    The canvas is valid until the next frame."""
    canvas = np.zeros((*shape, 4), np.uint8)
    for image, flat in zip(images, samples):
        x, y, w, h = (image[k] for k in ("x", "y", "width", "height"))
        part = canvas[y : y + h, x : x + w]
        if len(flat) < w * h or image["interlaced"] or image["clear"] is not None or part.shape[:2] != (h, w):
            drawn = np.arange(w * h).reshape(h, w) < len(flat)  # a stream that ends early leaves the rest as it was
            index = np.concatenate([flat, np.zeros(w * h - len(flat), np.uint8)]).reshape(h, w)
            if image["interlaced"]:
                rows = np.argsort(np.concatenate([np.arange(first, h, step) for first, step in PASSES]))
                index, drawn = index[rows], drawn[rows]
            if image["clear"] is not None:
                drawn = drawn & (index != image["clear"])
            index, drawn = index[: part.shape[0], : part.shape[1]], drawn[: part.shape[0], : part.shape[1]]
        else:
            index, drawn = flat.reshape(h, w), ...
        kept = part.copy() if image["disposal"] == 3 else 0
        part[drawn] = image["palette"][index[drawn]]
        yield {k: image[k] for k in ("start_cs", "delay_cs", "x", "y", "width", "height")} | {"canvas": canvas}
        if image["disposal"] > 1:
            part[...] = kept


def decode_gifs(files: list[bytes | None], most_pixels: int | None = MOST_PIXELS) -> Iterator[tuple[list[dict] | None, str | None]]:
    """For each file its frames, drawn one by one, or why it is no GIF.  The code streams of all are read together."""
    parsed, errors = [], []
    for data in files:
        try:
            parsed.append(((0, 0), []) if data is None else parse_gif(data, most_pixels))
            errors.append(None)
        except (ValueError, IndexError, struct.error) as e:
            parsed.append(((0, 0), []))
            errors.append(str(e) or type(e).__name__)
    every = [image for _, images in parsed for image in images]
    for size in {image["size"] for image in every}:
        some = [image for image in every if image["size"] == size]
        found = lzw_samples([i["codes"] for i in some], size, [i["width"] * i["height"] for i in some])
        for image, flat in zip(some, found):
            image["flat"] = flat
    for data, (shape, images), error in zip(files, parsed, errors):
        yield (None if data is None else draw(shape, images, [i["flat"] for i in images])), error


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels in each of LEVELS**3 colour cells."""
    cell = canvas >> (8 - LEVELS.bit_length() + 1)
    cell = (cell[..., 0] * LEVELS + cell[..., 1]) * LEVELS + cell[..., 2]
    opaque = canvas[..., 3] > 0
    return np.bincount(cell.ravel() if opaque.all() else cell[opaque], minlength=LEVELS**3)


def portions(items: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, last) of runs that hold about `most` bytes, so that a batch of long rows is worked off in parts."""
    first, held = 0, 0
    for i, x in enumerate(items):
        if held and held + len(x or b"") > most:
            yield first, i
            first, held = i, 0
        held += len(x or b"") + 64
    if first < len(items):
        yield first, len(items)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, gif: each text's UTF-8 bytes, zeros up to a positive multiple of WIDTH, as 8-bit samples of a GIF.

    A null or empty text is one row of zeros; rows are independent, so ties, repeated rows and an empty table need no care;
    other columns are dropped, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [b"" if t is None else t.encode() for t in batch["text"]]
            for i, j in portions(raw):
                padded = [t + bytes(max(WIDTH, -(-len(t) // WIDTH) * WIDTH) - len(t)) for t in raw[i:j]]
                yield pd.DataFrame({"key": batch["key"].iloc[i:j], "n_bytes": [len(t) for t in raw[i:j]], "gif": encode_gifs(padded)})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    stored = rows.mapInPandas(run, "key string, n_bytes long, gif binary")
    return stored.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_bytes", "gif")


def read_frames(media: DataFrame, gif: str = "gif", pixels: bool = False, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """media with what its GIFs hold: frames (times, place, histogram; pixels adds the RGBA canvas), samples (the red channel
    of the drawn parts, in order; what store_texts() stored) and error (null, or why the bytes are no whole GIF, or that it
    declares over most_pixels pixels; a task holds a few bytes for each, and with None there is no bound).

    A null gif has null frames and samples and no error.  Columns of media keep their values; its own columns called
    frames, samples or error give way.
    """
    kept = [c for c in media.columns if c not in ("frames", "samples", "error")]
    frame_type = FRAMES.replace("histogram", "rgba:binary,histogram") if pixels else FRAMES

    def read(drawn, error):
        if drawn is None:
            return None, None, None
        frames, samples = [], []
        for f in drawn:
            canvas = f.pop("canvas")
            samples.append(canvas[f["y"] : f["y"] + f["height"], f["x"] : f["x"] + f["width"], 0].tobytes())
            frames.append(f | ({"rgba": canvas.tobytes()} if pixels else {}) | {"histogram": histogram(canvas).tolist()})
        return frames, b"".join(samples), error

    fields = [(k, pa.int32()) for k in ("start_cs", "delay_cs", "x", "y", "width", "height")] + [("rgba", pa.binary())] * pixels + [("histogram", pa.list_(pa.int64()))]
    kinds = (pa.list_(pa.struct(fields)), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(kept.index(gif)).to_pylist()
            for i, j in portions(files):
                found = [read(*x) for x in decode_gifs(files[i:j], most_pixels)]
                made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], [*kept, "frames", "samples", "error"])

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept) + f", frames {frame_type}, samples binary, error string"
    return media.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def frame_table(media: DataFrame, key: str, gif: str = "gif", most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """One row for each frame: key, frame, its times, place, RGBA canvas and histogram."""
    return read_frames(media.select(key, gif), gif, True, most_pixels).select(key, F.posexplode("frames").alias("frame", "f")).select(key, "frame", "f.*")
