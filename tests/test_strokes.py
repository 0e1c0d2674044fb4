"""Stroke masks against plain models of their rules."""

import math
import random

import pytest

from quadrille.operators import masks as m
from quadrille.operators import strokes as k
from quadrille.operators import templates as t

SIDE = 24


@pytest.fixture(scope="module")
def image():
    """A grey noise with a bright line of strokes."""
    rng = random.Random(4)
    cells = {}
    for y in range(SIDE):
        for x in range(SIDE):
            lit = 10 <= y <= 13 and 4 <= x <= 19 and x % 3 != 0
            base = 230 if lit else rng.randrange(30, 70)
            cells[y, x] = (base, base - rng.randrange(4), base - rng.randrange(4))
    return cells


def frame(spark, image):
    rows = [(1, y, x, float(r), float(g), float(b)) for (y, x), (r, g, b) in image.items()]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double")


def soft(gray, sigma):
    w = k.gauss(sigma)
    reach = range(-len(w) + 1, len(w))

    def once(v, dy, dx):
        out = {}
        for (y, x), _ in v.items():
            near = [(v[y + dy * d, x + dx * d], w[abs(d)]) for d in reach if (y + dy * d, x + dx * d) in v]
            out[y, x] = sum(a * b for a, b in near) / sum(b for _, b in near)
        return out

    return once(once(gray, 0, 1), 1, 0)


def test_frame_candidate(spark, image):
    gray = {p: round(0.299 * r + 0.587 * g + 0.114 * b) for p, (r, g, b) in image.items()}
    below = soft(gray, 6.0)
    on = {p for p, (r, g, b) in image.items() if max(r, g, b) >= 138 and round((max(r, g, b) - min(r, g, b)) * 255 / max(r, g, b)) <= 75 and gray[p] - below[p] >= 10}
    opened = {(y, x) for y, x in on if any(all((y + a + c, x + b + d) in on for c in (0, 1) for d in (0, 1)) for a in (-1, 0) for b in (-1, 0))}
    got = {(r["y"], r["x"]) for r in k.frame_candidate(frame(spark, image), SIDE, SIDE, SIDE).collect() if r["v"]}
    assert got == opened and got


def test_refined_mask_finds_the_line(spark, image):
    got = {(r["y"], r["x"]) for r in k.refined_mask(frame(spark, image), SIDE, SIDE, SIDE).collect() if r["v"]}
    strokes = {p for p, c in image.items() if c[0] > 200}
    assert len(strokes & got) > 0.9 * len(strokes)
    assert all(5 <= y <= 19 for y, _ in got)


def test_template_scores_are_one_where_it_was_cut(spark, image):
    pixels = frame(spark, image).selectExpr("image_id", "y", "x", "CAST(r AS long) AS v")
    region = spark.createDataFrame([(1, 5, 4, 10, 6, 4)], "image_id long, ord long, x long, y long, w long, h long")
    scores = {(r["y"], r["x"]): r["score"] for r in t.template_scores(pixels, t.cut_templates(pixels, region)).collect()}
    assert len(scores) == (SIDE - 3) * (SIDE - 5)
    assert math.isclose(scores[10, 4], 1.0) and max(scores.values()) <= 1 + 1e-12


def test_nearly_empty_masks_and_their_fallbacks(spark):
    """Images 1 to 4: enough of its own; none; little beside a fallback; little and no fallback, so the band of a text line."""
    wide, high = 60, 40
    own = {1: {(y, x) for y in range(4) for x in range(4)}, 2: set(), 3: {(0, 0)}, 4: {(0, 0)}}
    other = {1: {(9, 9)}, 2: {(9, 9)}, 3: {(9, 9)}, 4: set()}
    mask = lambda of: spark.createDataFrame([(i, y, x, 255 if (y, x) in of[i] else 0) for i in of for y in range(high) for x in range(wide)], "image_id long, y long, x long, v long")
    got = {}
    for r in m.joined_fallback(mask(own), mask(other), wide, high).collect():
        got.setdefault(r["image_id"], set()).update({(r["y"], r["x"])} if r["v"] else set())
    one = spark.createDataFrame([(4,)], "image_id long")
    band, core = ({(r["y"], r["x"]) for r in f(one, wide, high).collect() if r["v"]} for f in (k.text_band, k.text_core))
    assert got[1] == own[1] and got[2] == {(9, 9)} and got[3] == {(0, 0), (9, 9)}
    share = lambda s: len(s) / (wide * high)
    assert share(band) > 0.16 and share(core | {(0, 0)}) > 0.16  # too full both, so the first that has any: the core
    assert got[4] == core | {(0, 0)}
