"""Edges, template scores, peaks and detection against plain models and masks worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import detect as d
from quadrille.operators import edges as e
from quadrille.operators import strokes as k
from quadrille.operators import templates as t
from quadrille.plans import detect as plans


def raster(spark, rows, image=1):
    cells = [(image, y, x, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(cells, "image_id long, y long, x long, v long")


def drawn(df):
    return {(r["y"], r["x"]) for r in df.collect() if r["v"]}


# --- by hand -------------------------------------------------------------------------------------------------------


def test_canny_of_a_step(spark):
    """An upright step of 100: the size is 400 on both columns beside it, the left one is the ridge, up to the corners."""
    rows = [[0, 0, 0, 100, 100, 100]] * 4
    assert drawn(e.canny(raster(spark, rows), 40, 120, 6)) == {(y, 2) for y in range(4)}
    assert drawn(e.canny(raster(spark, rows), 40, 400, 6)) == set()  # none above the higher cutoff


def test_canny_follows_weak_pixels_from_strong_ones(spark):
    """A step that rises from 20 to 28: sizes 88, 100, 108, 116 and 116 right of it, of which the last two are strong; a step
    of 20 all the way down (size 80) has none and goes."""
    both = raster(spark, [[0, 0, 0, h, h, h] for h in (20, 22, 24, 26, 28)]).union(raster(spark, [[0, 0, 0, 20, 20, 20]] * 5, image=2))
    assert {(r["image_id"], r["y"], r["x"]) for r in e.canny(both, 30, 110, 6).collect() if r["v"]} == {(1, y, 3) for y in range(5)}


def test_bands_by_hand(spark):
    """Blurs of a rectangle: 1.2 reaches two pixels out but not in its corners, 0.8 one pixel without the corners."""
    one = spark.createDataFrame([(1,)], "image_id long")
    band = drawn(k.text_band(one, 40, 24))  # columns 4 to 36, rows 8 to 15
    assert {x for y, x in band if y == 10} == set(range(2, 39)) and {y for y, x in band if x == 20} == set(range(6, 18))
    assert (7, 3) in band and (6, 2) not in band and (6, 3) not in band and (8, 2) not in band and (9, 2) in band
    core = drawn(k.text_core(one, 40, 88))  # 16 rows of text, as 15.84 is rounded: rows 36 to 52
    assert {y for y, x in core if x == 20} == set(range(35, 54)) and (35, 6) not in core and (35, 7) in core
    assert {y for y, x in drawn(k.text_core(one, 40, 104)) if x == 20} == set(range(41, 63))  # 18.72 is 19, and 42.5 is 42: rows 42 to 61


def test_thickened_rounds_corners(spark):
    rows = [[255 if (y, x) == (3, 3) else 0 for x in range(8)] for y in range(8)]
    square = {(y, x) for y in range(1, 6) for x in range(1, 6)}
    assert drawn(k.thickened(raster(spark, rows))) == square - {(1, 1), (1, 5), (5, 1), (5, 5)}


# --- plain models --------------------------------------------------------------------------------------------------


def byte(x):
    return int(max(0, min(255, round(round(float(x), 6)))))


def blurred(v, sigma):
    w = k.gauss(sigma)

    def rows(a):
        out = np.empty(a.shape)
        for x in range(a.shape[1]):
            near = [n for n in range(a.shape[1]) if abs(n - x) < len(w)]
            weigh = np.array([w[abs(n - x)] for n in near])
            out[:, x] = a[:, near] @ weigh / weigh.sum()
        return out

    return rows(rows(np.asarray(v, float)).T).T


def canny(v, low, high):
    h, w = v.shape
    p = np.pad(v.astype(int), 1, mode="edge")
    n = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = sum(c * (n(dy, 1) - n(dy, -1)) for dy, c in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(c * (n(1, dx) - n(-1, dx)) for dx, c in ((-1, 1), (0, 2), (1, 1)))
    m = abs(gx) + abs(gy)
    big = np.pad(m, 1)
    keep = set()
    for y in range(h):
        for x in range(w):
            a, b = abs(int(gx[y, x])), abs(int(gy[y, x]))
            if b * 32768 < a * 13573:
                dy, dx, tie = 0, 1, True
            elif b * 32768 > a * (13573 + 65536):
                dy, dx, tie = 1, 0, True
            else:
                dy, dx, tie = 1, -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1, False
            before, after, own = big[1 + y - dy, 1 + x - dx], big[1 + y + dy, 1 + x + dx], m[y, x]
            if own > low and own > before and (own > after or tie and own == after):
                keep.add((y, x))
    edge, todo = set(), [c for c in keep if m[c] > high]
    while todo:
        y, x = todo.pop()
        if (y, x) not in edge:
            edge.add((y, x))
            todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (y + i, x + j) in keep]
    out = np.zeros(v.shape, int)
    for c in edge:
        out[c] = 255
    return out


@pytest.mark.parametrize("seed", range(3))
def test_canny_against_a_plain_one(spark, seed):
    rng = random.Random(seed)
    v = np.array([[rng.randrange(256) if rng.random() < 0.3 else 40 * (x // 5) for x in range(23)] for _ in range(17)])
    want = canny(v, 90, 300)
    got = np.zeros(v.shape, int)
    for r in e.canny(raster(spark, v), 90, 300, 23).collect():
        got[r["y"], r["x"]] = r["v"]
    assert (got == want).all() and 0 < (want > 0).sum() < want.size


def tones(r, g, b):
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    saturation = np.where(top > 0, np.rint((top - low) * 255 / np.maximum(top, 1)), 0)
    return np.rint(r * 0.299 + g * 0.587 + b * 0.114), np.floor(top * (255 - saturation) / 255)


bytes_ = np.vectorize(byte, otypes=[float])


def sharp(gray, sigma, own):
    return bytes_(gray * own - bytes_(blurred(gray, sigma)) * (own - 1))


def surface(r, g, b):
    gray, white = tones(r, g, b)
    s = sharp(gray, 3.0, 1.8)
    return bytes_(bytes_(white * 0.75 + s * 0.2) * 0.9 + canny(s, 40, 120) * 0.1)


def spread(m, pick):
    h, w = m.shape
    return np.array([[pick(m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]) for x in range(w)] for y in range(h)])


def mask_of(r, g, b):
    gray, white = tones(r, g, b)
    best = (-1.0, 0)
    for c in sorted(set(white.ravel())):
        dark, light = white[white <= c], white[white > c]
        between = round(len(dark) * len(light) * (dark.mean() - light.mean()) ** 2, 6) if len(light) else 0.0
        best = max(best, (between, -c))
    full = spread(spread(spread(np.where((canny(sharp(gray, 2.2, 1.9), 30, 110) > 0) | (white > -best[1]), 255, 0), np.max), np.max), np.min)
    weak = spread(canny(gray, 20, 90), np.max)
    if 0.015 <= (full > 0).mean() <= 0.42:
        return full > 0
    return weak > 0 if 0.01 <= (weak > 0).mean() <= 0.45 else None


def scaled(cells, mask, scale):
    h, w = cells.shape
    nh, nw = max(8, round(h * scale)), max(8, round(w * scale))
    out = np.zeros((nh, nw))
    for y in range(nh):
        for x in range(nw):
            py, px = (y + 0.5) * h / nh - 0.5, (x + 0.5) * w / nw - 0.5
            for i in (0, 1):
                for j in (0, 1):
                    a, b = math.floor(py) + i, math.floor(px) + j
                    out[y, x] += cells[max(0, min(h - 1, a)), max(0, min(w - 1, b))] * (1 - abs(py - a)) * (1 - abs(px - b))
    near = None if mask is None else np.array([[mask[min(h - 1, y * h // nh), min(w - 1, x * w // nw)] for x in range(nw)] for y in range(nh)])
    return bytes_(out), near


def scores(image, cells, mask):
    (h, w), m = cells.shape, np.ones(cells.shape) if mask is None else mask.astype(float)
    out = np.zeros((max(0, image.shape[0] - h + 1), max(0, image.shape[1] - w + 1)))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            part, own = image[y : y + h, x : x + w] * m, cells * m
            if mask is None:
                part, own = part - part.mean(), own - own.mean()
            vv, tt = (part * part).sum(), (own * own).sum()
            out[y, x] = (part * own).sum() / math.sqrt(vv * tt) if vv > 1e-6 and tt > 1e-6 else 0.0
    return out


def picked(s, w, h, pad, threshold, limit):
    s, out = s.copy(), []
    for _ in range(limit):
        if not s.size or (best := np.round(s, 12).max()) < threshold:
            break
        y, x = map(int, np.argwhere(np.round(s, 12) == best)[0])
        out.append((x, y, w, h, float(s[y, x])))
        s[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad] = -1
    return out


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def alone(regions):
    kept = []
    for r in regions:
        if all(iou(r, o) < 0.45 for o in kept):
            kept.append(r)
    return kept


def combined(seeds, found):
    rows = [(1.0, r, {*()}, True) for r in seeds] + [(m[4], m[:4], {i}, False) for i, ms in enumerate(found) for m in ms]
    merged = []
    for score, r, sources, seed in sorted(rows, key=lambda x: -x[0]):
        hit = next((m for m in merged if iou(r, m[0]) >= 0.38), None)
        if hit:
            hit[1], hit[2] = hit[1] | sources, hit[2] or seed
        else:
            merged.append([r, sources, seed])
    least = 1 if len(seeds) <= 1 else 2
    return sorted((m[0] for m in merged if m[2] or len(m[1]) >= least), key=lambda r: (r[1], r[0]))


def clamped(r, width, height):
    x, y, w, h = max(0, r[0]), max(0, r[1]), r[2], r[3]
    w, h = min(w, width - x), min(h, height - y)
    return (x, y, w, h) if min(r[2], r[3], w, h) > 4 else None


def grown(base, match, width, height):
    many = len(base) >= 3
    limit = max(len(base), 12 if many else min(18, len(base) + 12))
    current = list(base)
    for _ in range(3 if many else 1):
        seeds = [c for r in current if (c := clamped(r, width, height))]
        merged = alone(combined(seeds, [match(r) for r in seeds]))
        if len(merged) <= len(current):
            break
        current = merged[:limit]
        if len(current) >= limit:
            break
    added = []
    for r in current:
        if len(alone(base + added + [r])) > len(base) + len(added):
            added.append(r)
    return alone(base + added)


def test_detection_against_a_plain_one(spark):
    """Scenes with three equal marks, of which one, two or all are given."""
    sf = "/root/testdata/sf0.001"
    if not plans.pixels(spark, sf).columns:
        pytest.skip("no tables")
    rgb = plans.scenes(spark, sf).filter("image_id < 4").cache()
    base = plans.seeds(spark, sf).filter("image_id < 4")
    got = {}
    for r in d.detect_repeated(rgb, base, plans.SCENE, plans.SCENE).collect():
        got.setdefault(r["image_id"], set()).add((r["x"], r["y"], r["w"], r["h"]))
    colours = {i: [np.zeros((plans.SCENE, plans.SCENE)) for _ in range(3)] for i in range(4)}
    for p in rgb.collect():
        for c, n in zip(colours[p["image_id"]], "rgb"):
            c[p["y"], p["x"]] = p[n]
    for i, rows in colours.items():
        seeds = [(r["x"], r["y"], r["w"], r["h"]) for r in sorted(base.filter(F.col("image_id") == i).collect(), key=lambda r: r["ord"])]
        face = surface(*rows)

        def match(r):
            x, y, w, h = r
            if w < 8 or h < 8:
                return []
            cells, mask, out = face[y : y + h, x : x + w], mask_of(*[c[y : y + h, x : x + w] for c in rows]), []
            for scale in (None, 0.92, 1.08):
                c, m = (cells, mask) if scale is None else scaled(cells, mask, scale)
                out += picked(scores(face, c, m), c.shape[1], c.shape[0], max(6, min(w, h) // 3), 0.44, 6)
            return out

        assert got[i] == set(grown(seeds, match, plans.SCENE, plans.SCENE))
    found = [sum(any(iou((x, y, 16, 8), r) > 0.5 for r in got[i]) for x, y in plans.PLACES) for i in range(4)]
    assert sorted(found)[1:] == [3, 3, 3]  # from one place of the mark the others are found; in one scene the pixel that is too many hides one


def test_growth_against_a_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    from quadrille.operators import geometry as g
    from quadrille.sources.tables import HEIGHT, WIDTH, regions

    base, got = {}, {}
    for r in sorted(g.clamp_regions(regions(spark, sf), WIDTH, HEIGHT).filter("ord <= 4").collect(), key=lambda r: r["ord"]):
        base.setdefault(r["image_id"], []).append((r["x"], r["y"], r["w"], r["h"]))
    for r in sorted(plans.growth(spark, sf).collect(), key=lambda r: r["ord"]):
        got.setdefault(r["image_id"], []).append((r["x"], r["y"], r["w"], r["h"]))

    def match(r):
        return [(r[0] + m, *r[1:], 0.9 - m / 1000) for m in (40, 80) if r[0] + m + r[2] <= WIDTH]

    want = {i: grown(rs, match, WIDTH, HEIGHT) for i, rs in base.items()}
    assert got == want and any(len(want[i]) > len(base[i]) for i in base)


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_scores_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(2)
    image = np.array([[rng.randrange(256) for _ in range(19)] for _ in range(13)])
    cells, mask = image[4:8, 5:11].astype(float), np.array([[(y + x) % 3 > 0 for x in range(6)] for y in range(4)])
    rows = [(1, n, y, x, float(cells[y, x]), int(mask[y, x]) if n == 1 else 1, n == 2) for n in (1, 2) for y in range(4) for x in range(6)]
    rows += [(1, 3, y, x, 1.0, 1, False) for y in range(40) for x in range(2)]  # fits nowhere
    templates = spark.createDataFrame(rows, "image_id long, template long, dy long, dx long, t double, m int, centred boolean")
    got = {(r["template"], r["y"], r["x"]): r["score"] for r in t.template_scores(raster(spark, image), templates, tile=tile).collect()}
    for n, m in ((1, mask), (2, None)):
        want = scores(image, cells, m)
        assert {(y, x): round(v, 9) for (k_, y, x), v in got.items() if k_ == n} == {c: round(float(v), 9) for c, v in np.ndenumerate(want)}
        assert math.isclose(got[n, 4, 5], 1.0)
    assert {k_ for k_, *_ in got} == {1, 2}


@pytest.mark.parametrize("block", [1, 4, 100])
def test_peaks_do_not_depend_on_blocks(spark, block):
    rng = random.Random(6)
    faces = {n: np.array([[rng.randrange(12) / 12 for _ in range(20)] for _ in range(15)]) for n in (1, 2)}
    rows = [(1, n, y, x, float(v)) for n, f in faces.items() for (y, x), v in np.ndenumerate(f)] + [(2, 1, 0, 0, 0.1)]
    sizes = spark.createDataFrame([(1, 1, 3, 2, 1), (1, 2, 5, 4, 2), (2, 1, 2, 2, 1)], "image_id long, template long, w long, h long, pad long")
    picks = t.pick_peaks(spark.createDataFrame(rows, "image_id long, template long, y long, x long, score double"), sizes, 0.5, 7, block)
    got = {}
    for r in sorted(picks.collect(), key=lambda r: r["pick"]):
        got.setdefault((r["image_id"], r["template"]), []).append((r["x"], r["y"], r["score"]))
    assert got == {(1, n): [(x, y, s) for x, y, _, _, s in picked(f, *w, 0.5, 7)] for (n, f), w in zip(faces.items(), ((3, 2, 1), (5, 4, 2)))}
    none = t.pick_peaks(picks.drop("pick"), sizes, 2.0, 3, block)
    assert none.columns == picks.columns and none.count() == 0
