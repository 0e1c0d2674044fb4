"""The rules of masks.fuse_guarded(), fallback() with its strokes, and joined_fallback() on crops whose masks are columns of one row a pixel.

A crop's masks follow from its own pixels, so the rules are worked off in Arrow batches of whole crops, which lie in parts by image:
steps between masks write no table, sort no pixel and join none.  Crops are dense rasters of the frame's size or less.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .raster import SOLID, component_sizes, whole_images
from .strokes import gauss

#: What rounding to six decimals adds at most.
HALF = 5e-7


class Crops:
    """The pixels of a batch of whole crops, as columns, and as rasters side by side."""

    def __init__(self, batch: pa.RecordBatch, side: int, width: int, height: int):
        self.batch, self.side, self.width, self.height = batch, side, width, height
        image, self.y, self.x = (batch.column(c).to_numpy() for c in ("image_id", "y", "x"))
        self.of = np.cumsum(np.concatenate([[False], image[1:] != image[:-1]]))
        self.count = np.bincount(self.of)
        self.shape = len(self.count), int(self.y.max()) + 1, int(self.x.max()) + 1
        self.there = self.raster(np.ones(batch.num_rows))

    def __getattr__(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy()

    def raster(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape, v.dtype)
        out[self.of, self.y, self.x] = v
        return out

    def pixels(self, raster: np.ndarray) -> np.ndarray:
        return raster[self.of, self.y, self.x]

    def share(self, v: np.ndarray) -> np.ndarray:
        """The share of each crop that is set."""
        return np.bincount(self.of, v == 255, len(self.count)) / self.count

    def choose(self, layers: list[np.ndarray], rules: list[tuple[np.ndarray, int]], last: int) -> np.ndarray:
        """Of each crop the layer that its first rule names, which holds for it."""
        choice = np.select([holds for holds, _ in rules], [k for _, k in rules], last)
        return np.choose(choice[self.of], layers)


def _beside(raster: np.ndarray, axis: int, k: int) -> np.ndarray:
    """The raster moved so that each pixel has the one k further on along the axis; 0 beyond the edge."""
    out = np.zeros_like(raster)
    to, of = [slice(None)] * 3, [slice(None)] * 3
    to[axis], of[axis] = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k)) if k else (slice(None), slice(None))
    out[tuple(to)] = raster[tuple(of)]
    return out


def _largest(raster: np.ndarray, radius: int) -> np.ndarray:
    for axis in (1, 2):
        raster = np.maximum.reduce([_beside(raster, axis, k) for k in range(-radius, radius + 1)])
    return raster


def _blurred(c: Crops, raster: np.ndarray, sigma: float) -> np.ndarray:
    """strokes.blur(), with its sums in the same order."""
    weights = gauss(sigma)
    for axis in (2, 1):
        total, mass = np.zeros(c.shape), np.zeros(c.shape)
        for k in range(-len(weights) + 1, len(weights)):
            total += _beside(raster, axis, k) * weights[abs(k)]
            mass += _beside(c.there, axis, k) * weights[abs(k)]
        raster = np.divide(total, mass, out=np.zeros(c.shape), where=c.there > 0)
    return raster


def _mask(on: np.ndarray) -> np.ndarray:
    return np.where(on, 255, 0)


def letters(c: Crops, v: np.ndarray) -> np.ndarray:
    """Where raster.text_like() holds for the component of a pixel that is set."""
    area, w, h = component_sizes(c.batch, v > 0, c.side)
    most, widest, highest = max(120, c.width * c.height * 0.065 // 1), max(36, c.width * 0.78 // 1), max(18, c.height * 0.78 // 1)
    filled = (area / np.maximum(1, w * h) > 0.82) & (area > 48)
    return _mask((area >= 4) & (area <= most) & (w <= widest) & (h <= highest) & ~filled)


def thicken(c: Crops, v: np.ndarray) -> np.ndarray:
    """strokes.thickened()."""
    return _mask(c.pixels(_blurred(c, _largest(c.raster(v), 1).astype(float), 0.8)) >= SOLID - HALF)


def smooth(c: Crops, v: np.ndarray) -> np.ndarray:
    """masks.smooth()."""
    return thicken(c, letters(c, v))


def _percentile(c: Crops, v: np.ndarray, part: float) -> np.ndarray:
    """Of each crop the value that the part of its pixels is under, between two pixels in proportion."""
    v, at = v[np.lexsort((v, c.of))].astype(float), (c.count - 1) * part
    low, first = np.floor(at), np.cumsum(c.count) - c.count
    a, b = v[first + low.astype(int)], v[first + np.ceil(at).astype(int)]
    return np.where(a == b, a, (low + 1 - at) * a + (at - low) * b)


def refined(c: Crops, low: float = 0.003, high: float = 0.18) -> np.ndarray:
    """strokes.refined_mask() of columns value, saturation, gray and wide_band."""
    gray = c.raster(c.gray.astype(float))
    most = gray.max() + 1
    eroded = most - _largest(np.where(c.there > 0, most - gray, 0), 2)
    opened = c.pixels(_largest(np.where(c.there > 0, eroded, 0), 2))
    bright, calm = np.maximum(128.0, _percentile(c, c.value, 0.62)), np.minimum(110.0, _percentile(c, c.saturation, 0.58))
    relaxed = (c.value >= bright[c.of]) & (c.saturation <= calm[c.of]) & (c.wide_band > 0)
    stroke = (c.gray - c.pixels(_blurred(c, gray, 6.0)) >= 8 - HALF) | (c.gray - opened >= 10)
    strict = smooth(c, _mask(relaxed & stroke))
    own, loose = c.share(strict), c.share(_mask(relaxed))
    rules = [((own >= low) & (own <= min(high, 0.085)), 0), ((own < low) & (loose >= low) & (loose <= min(high, 0.12)), 1), (own > 0, 0)]
    return c.choose([strict, thicken(c, _mask(relaxed)), _mask(c.wide_band > 0)], rules, 2)


def trim(c: Crops, v: np.ndarray) -> np.ndarray:
    """raster.trim_to_projection()."""
    on, inside, bare = c.raster((v > 0).astype(np.int64)), v >= SOLID, np.zeros(len(c.count), bool)
    for at, other, share, pad, size in ((c.y, 2, 0.16, max(3, round(c.height * 0.08)), c.height), (c.x, 1, 0.08, max(6, round(c.width * 0.06)), c.width)):
        hits = on.sum(axis=other)
        held = hits >= np.maximum(2, np.floor(hits.max(axis=1) * share))[:, None]
        low, high = held.argmax(axis=1), hits.shape[1] - held[:, ::-1].argmax(axis=1)
        inside &= (at >= np.clip(low - pad, 0, size)[c.of]) & (at <= np.clip(high + pad, 0, size)[c.of])
        bare |= ~held.any(axis=1)
    return np.where(bare[c.of], v, _mask(inside))


def enough(c: Crops, v: np.ndarray, low: float, high: float) -> np.ndarray:
    """masks.enough()."""
    layers = [v, np.maximum(v, c.band), c.band, np.maximum(v, c.core), c.core]
    shares = [c.share(x) for x in layers]
    fits = [((shares[k] >= low) & (shares[k] <= high), k) for k in (1, 2, 3, 4)]
    return c.choose(layers, [(shares[0] >= low, 0), *fits, *[(shares[k] > 0, k) for k in (3, 4, 1, 2)]], 0)


def fused(c: Crops) -> np.ndarray:
    """masks.fuse_guarded() of columns steady and model."""
    steady, model = (trim(c, smooth(c, v)) for v in (c.steady, c.model))
    near = c.pixels(_largest(c.raster(steady), 2)) >= SOLID
    both = smooth(c, trim(c, np.maximum(steady, np.where(near, model, 0))))
    s, m, b = (c.share(v) for v in (steady, model, both))
    told = enough(c, c.choose([steady, model, both], [(s <= 0, 1), (m <= 0, 0), (b > 0.18, 0), ((b < 0.003) & (m > s), 1)], 2), 0.010, 0.18)
    return np.where(((s <= 0) & (m <= 0))[c.of], 0, told)


def fallen_back(c: Crops) -> np.ndarray:
    """masks.fallback() of the columns of refined(), and in_band, in_core, stripe and bare of masks.supports()."""
    in_band, in_core, bare = (c.share(v) for v in (c.in_band, c.in_core, c.bare))
    rules = [(bare > 0, 0), ((in_band >= 0.002) & (in_band <= 0.18), 1), (in_core >= 0.002, 2), (in_band >= 0.002, 1)]
    support, strokes = c.choose([c.core, c.in_band, c.in_core, c.stripe], rules, 3), trim(c, smooth(c, refined(c)))
    both = np.maximum(strokes, support)
    s, b = c.share(support), c.share(both)
    return enough(c, c.choose([support, both], [((b <= 0) | ((b > 0.20) & (s > 0) & (s < b)), 0)], 1), 0.006, 0.16)


def steady_or_fallen_back(c: Crops) -> np.ndarray:
    """masks.joined_fallback() of both."""
    own, other = fused(c), fallen_back(c)
    f, o = c.share(own), c.share(other)
    return c.choose([own, other, np.maximum(own, other), enough(c, own, 0.006, 0.16)], [(f >= 0.003, 0), (f <= 0, 1), (o > 0, 2)], 3)


def by_rule(pixels: DataFrame, rule, side: int, width: int, height: int) -> DataFrame:
    """image_id, y, x, v: what the rule makes of pixels(image_id, y, x, band, core, and the rule's columns), each image in one part; those
    without an image go.  side is over every x."""

    def run(batches):
        for batch in whole_images(batches):
            kept = [batch.column(c) for c in ("image_id", "y", "x")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rule(Crops(batch, side, width, height)), pa.int64())], ["image_id", "y", "x", "v"])

    rows = pixels.filter("image_id IS NOT NULL").sortWithinPartitions("image_id")
    return rows.mapInArrow(run, rows.select("image_id", "y", "x").schema.add("v", "long"))
