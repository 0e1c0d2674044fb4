"""Finding templates in rasters: cutting and scaling them, scores in tiles, and picking peaks.

An image is cut into tiles of places; a tile holds the pixels that its places need, with a halo as wide as the image's largest
template, so an image spreads over many tasks.  Inside a tile products come from Fourier transforms and window sums from running
sums; no pair of a pixel and a cell is ever a row.  Peaks are picked on the maxima of blocks, and only blocks that lose their
maximum to a pick are read again.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import half_even
from ..sources.shared import by_merge, cut

#: Places along a side of a tile, and of a block of scores.
TILE, BLOCK = 128, 64
#: Pixels of rasters that are transformed at a time.
SLAB = 1 << 18
CELL = ["image_id", "template"]


def cut_templates(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, template, dy, dx, t: the pixels of each region as a template; template is the region's ord."""
    inside = F.expr("p.image_id = r.image_id AND p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h")
    return pixels.alias("p").join(regions.alias("r"), inside).select("p.image_id", F.col("r.ord").alias("template"), (F.col("p.y") - F.col("r.y")).alias("dy"), (F.col("p.x") - F.col("r.x")).alias("dx"), F.col("p.v").alias("t"))


def _resized(templates: DataFrame, value: str, scale: float, least: int) -> DataFrame:
    """image_id, template, h, w, nh, nw, cells, whole, dy, dx: the places of the scaled templates, each with all cells of its
    template, sorted, and whether none is missing.  A template is one row until its places are told, so no cell is joined."""
    packed = templates.dropna(subset=[*CELL, "dy", "dx"]).groupBy(*CELL).agg((F.max("dy") + 1).alias("h"), (F.max("dx") + 1).alias("w"), F.sort_array(F.collect_list(F.struct("dy", "dx", F.col(value).alias("value")))).alias("cells"))
    packed = packed.withColumns({"nh": F.greatest(F.lit(least), half_even(F.col("h") * scale)), "nw": F.greatest(F.lit(least), half_even(F.col("w") * scale))})
    place = F.transform("cells", lambda c: c["dy"] * F.col("w") + c["dx"])
    whole = (F.size("cells") == F.col("h") * F.col("w")) & (F.array_min(F.col("cells.dx")) >= 0) & (place == F.sequence(F.lit(0).cast("long"), F.col("h") * F.col("w") - 1))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return packed.withColumn("whole", whole).withColumn("dy", upto("nh")).withColumn("dx", upto("nw"))


def _cell(y: Column, x: Column) -> Column:
    """The cell at a place of a template of which none is missing."""
    return F.get("cells", (y * F.col("w") + x).cast("int"))["value"]


def _cells_at(y: Column, x: Column) -> Column:
    """The cells that there are at a place."""
    return F.filter("cells", lambda c: (c["dy"] == y) & (c["dx"] == x))


def scale_templates(templates: DataFrame, scale: float, least: int = 8) -> DataFrame:
    """templates(image_id, template, dy, dx, t) resized by scale, to least cells a side at least, by weighing the four cells
    around each place; beyond the edge the edge counts."""
    cells = _resized(templates, "t", scale, least)

    def near(d: str, n: str, new: str, k: int) -> tuple[Column, Column]:
        place = (F.col(d) + 0.5) * F.col(n) / F.col(new) - 0.5
        return F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(place) + k)).cast("long"), 1 - F.abs(place - F.floor(place) - k)

    around = [(*near("dy", "h", "nh", i), *near("dx", "w", "nw", j)) for i in (0, 1) for j in (0, 1)]
    told = [_cell(y, x) * v * u for y, v, x, u in around]
    whole = F.when(F.coalesce(*told).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in told), F.lit(0.0)))
    parts = F.concat(*[F.transform(_cells_at(y, x), lambda c: c["value"] * v * u) for y, v, x, u in around])
    known = F.filter(parts, lambda p: p.isNotNull())
    some = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, p: acc + p))
    return cells.filter(F.col("whole") | (F.size(parts) > 0)).select(*CELL, "dy", "dx", F.when(F.col("whole"), whole).otherwise(some).alias("t"))


def scale_masks(masks: DataFrame, scale: float, least: int = 8) -> DataFrame:
    """masks(image_id, template, dy, dx, m) resized as their templates, by the cell that each place falls in."""
    near = lambda d, n, new: F.least(F.col(n) - 1, F.floor(F.col(d) * F.col(n) / F.col(new))).cast("long")
    y, x = near("dy", "h", "nh"), near("dx", "w", "nw")
    cells = _resized(masks, "m", scale, least)
    found = F.when(F.col("whole"), F.array(_cell(y, x))).otherwise(F.transform(_cells_at(y, x), lambda c: c["value"]))
    return cells.select(*CELL, "dy", "dx", F.explode(found).alias("m"))


def _window_sums(values: np.ndarray, h: int, w: int) -> np.ndarray:
    sums = np.zeros((len(values), values.shape[1] + 1, values.shape[2] + 1))
    np.cumsum(np.cumsum(values, 1), 2, out=sums[:, 1:, 1:])
    return sums[:, h:, w:] - sums[:, :-h, w:] - sums[:, h:, :-w] + sums[:, :-h, :-w]


def tile_scores(rasters: np.ndarray, of: np.ndarray, cells: np.ndarray, masks: np.ndarray, centred: bool, full: bool) -> np.ndarray:
    """Scores of templates of one size at all places where they fit, each in the raster that `of` names.  full: no mask has a 0."""
    (h, w), shape = cells.shape[1:], rasters.shape[1:]
    exact = ((rasters == np.rint(rasters)).all((1, 2))[of] & (cells == np.rint(cells)).all((1, 2)))[:, None, None]
    each = lambda v: v[:, None, None]

    def products(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.fft.irfft2(np.fft.rfft2(values)[of] * np.conj(np.fft.rfft2(weights, shape)), shape)[:, : shape[0] - h + 1, : shape[1] - w + 1]
        return np.where(exact, np.rint(out), out)  # sums of whole numbers are exact

    cells = cells * masks
    vt = products(rasters, cells)
    vv = _window_sums(rasters * rasters, h, w)[of] if full else products(rasters * rasters, masks)
    n, tt = each(masks.sum((1, 2))), each((cells * cells).sum((1, 2)))
    if centred:
        s, total = _window_sums(rasters, h, w)[of] if full else products(rasters, masks), each(cells.sum((1, 2)))
        vt, vv, tt = n * vt - s * total, n * vv - s * s, n * tt - total * total
        vv[vv < 1e-6] = 0
    return np.divide(vt, np.sqrt(np.maximum(vv, 0) * tt), out=np.zeros_like(vt), where=(vv > 0) & (tt > 1e-6))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] values for each i, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of an array of lists, and which list each is of."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _column(rows: pa.StructArray, name: str) -> np.ndarray:
    found = rows.field(name)
    return (found.fill_null(False) if pa.types.is_boolean(found.type) else found).to_numpy(zero_copy_only=False)


def _scores_of(tile: int, least: float | None):
    """Batches of tiles, each with its pixels and its image's templates: what has one size is worked off together."""

    def scored(batch: pa.RecordBatch):
        image, ty, tx = (batch.column(c).to_numpy() for c in ("image_id", "ty", "tx"))
        pixels, at = _flat(batch.column("pixels"))
        y, x, v = _column(pixels, "y") - ty[at] * tile, _column(pixels, "x") - tx[at] * tile, _column(pixels, "v")
        first = np.searchsorted(at, np.arange(len(image) + 1))
        size = np.stack([np.maximum.reduceat(c, first[:-1]) + 1 for c in (y, x)], 1)
        known, owner = _flat(batch.column("templates"))
        name, h, w, centred = (_column(known, c) for c in ("template", "h", "w", "centred"))
        parts, part = _flat(known.field("c"))
        dy, dx, t, m = (_column(parts, c) for c in ("dy", "dx", "t", "m"))
        begin = np.searchsorted(part, np.arange(len(name) + 1))
        full = np.bincount(part[m > 0], minlength=len(name)) == h * w
        kinds = np.column_stack([size[owner], h, w, centred, full]).astype(np.int64)
        fits = np.flatnonzero((kinds[:, 2] <= kinds[:, 0]) & (kinds[:, 3] <= kinds[:, 1]))
        order = fits[np.lexsort((fits, *kinds[fits].T))]
        ends = np.flatnonzero((kinds[order][1:] != kinds[order][:-1]).any(1)) + 1
        for same in np.split(order, ends) if len(order) else []:
            high, wide, th, tw, mid, whole = (int(c) for c in kinds[same[0]])
            step = max(1, SLAB // (high * wide))
            for some in (same[i : i + step] for i in range(0, len(same), step)):
                own, of = np.unique(owner[some], return_inverse=True)
                rasters, cells, masks = np.zeros((len(own), high, wide)), *np.zeros((2, len(some), th, tw))
                count = first[own + 1] - first[own]
                k = _ranges(first[own], count)
                rasters[np.repeat(np.arange(len(own)), count), y[k], x[k]] = v[k]
                count = begin[some + 1] - begin[some]
                k, to = _ranges(begin[some], count), np.repeat(np.arange(len(some)), count)
                cells[to, dy[k], dx[k]], masks[to, dy[k], dx[k]] = t[k], m[k]
                score = tile_scores(rasters, of, cells, masks, bool(mid), bool(whole))[:, :tile, :tile]
                held, sy, sx = np.nonzero(score >= least) if least is not None else np.indices(score.shape).reshape(3, -1)
                row = owner[some][held]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (image[row], name[some][held], sy + ty[row] * tile, sx + tx[row] * tile, score[held, sy, sx])], CELL + ["y", "x", "score"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from scored(batch)

    return run


def template_scores(pixels: DataFrame, templates: DataFrame, tile: int = TILE, least: float | None = None) -> DataFrame:
    """templates(image_id, template, dy, dx, t: cells of small rasters; m: 0 for cells that don't count, may be missing;
    centred: whether values count as differences from their mean, may be missing) -> image_id, template, y, x, score: the
    normalised correlation with each place of the image where the template fits; 0 where either is all dark, or flat if
    centred.  With `least`, only places with that score or more."""
    has = lambda c, value: F.col(c) if c in templates.columns else F.lit(value)
    long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    cell = F.sort_array(F.collect_list(F.struct(*long("dy", "dx"), F.col("t").cast("double").alias("t"), (has("m", 1) > 0).cast("double").alias("m"))))
    packed = templates.groupBy(F.col("image_id").cast("long").alias("of"), F.col("template").cast("long").alias("template")).agg(cell.alias("c"), F.max(has("centred", False)).alias("centred"), (F.max("dy") + 1).cast("long").alias("h"), (F.max("dx") + 1).cast("long").alias("w"))
    images = packed.groupBy("of").agg(F.collect_list(F.struct("template", "centred", "h", "w", "c")).alias("templates"), F.max("h").alias("th"), F.max("w").alias("tw"))
    images = cut(images, "templates")
    # pixels become rows of tiles where their image is, and these spread over tasks
    tiles = lambda p, size: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(p) - F.col(size) + 1) / tile), F.floor(F.col(p) / tile)))
    rows = pixels.select(*long("image_id", "y", "x"), F.col("v").cast("double").alias("v")).join(by_merge(images.select("of", "th", "tw")), F.col("image_id") == F.col("of"))
    rows = rows.withColumn("ty", tiles("y", "th")).withColumn("tx", tiles("x", "tw"))
    rows = rows.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("y", "x", "v")).alias("pixels"))
    both = rows.join(by_merge(images.select("of", "templates")), F.col("image_id") == F.col("of")).select("image_id", "ty", "tx", "pixels", "templates")
    return both.repartition("image_id", "ty", "tx").mapInArrow(_scores_of(tile, least), "image_id long, template long, y long, x long, score double")


def pick_peaks(scores: DataFrame, sizes: DataFrame, threshold: float, limit: int, block: int = BLOCK) -> DataFrame:
    """scores(image_id, template, y, x, score), sizes(image_id, template, w, h, pad) -> image_id, template, pick, y, x, score.

    Of each template repeatedly the largest score is picked (the first by y, x of equals), after which places from pad before
    it to its size and pad after it count no more, until limit picks are made or no score of threshold is left.  A round works
    on the maxima of blocks; a block is read again only if its maximum lies in what the round's pick covers.
    """
    rank = F.struct("score", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    cells = [*CELL, "by", "bx"]
    held = cut(scores.filter(F.col("score") >= threshold).select(*CELL, "y", "x", "score", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")), "scores")
    tops = cut(held.groupBy(*cells).agg(F.max(rank).alias("top")), "tops")
    picks = None
    for n in range(1, limit + 1):
        best = tops.groupBy(*CELL).agg(F.max("top").alias("top")).join(sizes, CELL)
        x, y = -F.col("top.x"), -F.col("top.y")
        best = cut(best.select(*CELL, F.lit(n).cast("long").alias("pick"), y.alias("py"), x.alias("px"), F.col("top.score").alias("won"), (x - F.col("pad")).alias("x0"), (y - F.col("pad")).alias("y0"), (x + F.col("w") + F.col("pad")).alias("x1"), (y + F.col("h") + F.col("pad")).alias("y1")), "picks")
        if best.isEmpty():
            break
        picks = picks.unionByName(best) if picks else best
        if n == limit:
            break
        under = (-F.col("top.x") >= F.col("x0")) & (-F.col("top.x") < F.col("x1")) & (-F.col("top.y") >= F.col("y0")) & (-F.col("top.y") < F.col("y1"))
        lost = cut(tops.join(best, CELL).filter(under).select(*cells), "lost")
        covered = F.expr("s.image_id = p.image_id AND s.template = p.template AND s.x >= p.x0 AND s.x < p.x1 AND s.y >= p.y0 AND s.y < p.y1")
        left = held.join(lost, cells, "left_semi").alias("s").join(by_merge(picks).alias("p"), covered, "left_anti")
        tops = cut(tops.join(lost, cells, "left_anti").unionByName(left.groupBy(*cells).agg(F.max(rank).alias("top"))), "tops")
    if picks is None:
        return held.select(*CELL, F.lit(0).cast("long").alias("pick"), "y", "x", "score").limit(0)
    return picks.select(*CELL, "pick", F.col("py").alias("y"), F.col("px").alias("x"), F.col("won").alias("score"))
