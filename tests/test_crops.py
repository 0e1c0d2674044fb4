"""Work inside regions against plain models and values worked out by hand."""

import random

import pytest

from quadrille.operators import crops as c
from quadrille.operators import strokes as k

WIDE, HIGH = 200, 110


@pytest.fixture(scope="module")
def frame(spark):
    """A dark frame with a block of strokes in one part, a smooth bright field in another and noise elsewhere."""
    rng, rows = random.Random(9), []
    for y in range(HIGH):
        for x in range(WIDE):
            v = rng.randrange(20, 50)
            if 20 <= y < 32 and 30 <= x < 70 and x % 4 < 2:
                v = 235
            if 62 <= y < 105 and 40 <= x < 150:
                v = 150 + (x - 40) // 10 + (y - 62) // 20
            rows.append((1, y, x, float(v), float(v), float(v)))
    return spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double").cache()


def regions(spark, *boxes):
    return spark.createDataFrame([(1, n, *b) for n, b in enumerate(boxes, 1)], "image_id long, ord long, x long, y long, w long, h long")


def plain_window(s, w, h):
    """The padded window of a signal s[y][x] in a patch of w by h."""
    ww, wh = min(w, max(96, round(w * 0.72))), min(h, max(42, round(h * 0.62)))
    if max(map(max, s)) < 0.12 or w < 120 or h < 48 or ww >= w or wh >= h:
        return 0, 0, w, h
    best = None
    for y in range(0, h - wh + 1, 2):
        for x in range(0, w - ww + 1, 2):
            score = sum(sum(row[x : x + ww]) for row in s[y : y + wh]) - abs(x + ww / 2 - w / 2) * 0.03 - abs(y + wh / 2 - h / 2) * 0.05
            if best is None or round(score, 6) > best[0]:
                best = round(score, 6), x, y
    _, x, y = best
    px, py = max(4, round(w * 0.04)), max(4, round(h * 0.06))
    x0, y0, x1, y1 = max(0, x - px), max(0, y - py), min(w, x + ww + px), min(h, y + wh + py)
    return x0, y0, x1 - x0, y1 - y0


def test_regions_move_to_what_they_hold(spark, frame):
    boxes = [(0, 0, 190, 58), (30, 50, 160, 60), (0, 100, 30, 20), (500, 0, 10, 10), (-20, 40, 60, 12)]
    got = {r["ord"]: (r["x"], r["y"], r["w"], r["h"]) for r in c.tighten_to_strokes(frame, regions(spark, *boxes), WIDE, HIGH).collect()}
    x, y, w, h = got[1]  # around the strokes: at least 84 or 42 % wide, at least 38 high
    assert (w, h) == (84, 38) and x <= 30 and x + w >= 70 and y <= 20 and y + h >= 32
    values = {(r["y"], r["x"]): r["r"] / 255 for r in frame.collect()}
    signal = [[max(0.0, min(1.0, (values[50 + j, 30 + i] - 0.42) * 2.4)) for i in range(160)] for j in range(60)]
    a, b, w, h = plain_window(signal, 160, 60)
    assert got[2] == (30 + a, 50 + b, w, h) != (30, 50, 160, 60)
    assert got[3] == (0, 100, 30, 10)  # clipped: small, and nothing in it
    assert got[4] == (500, 0, 10, 10) and got[5] == (0, 40, 60, 12)  # outside it stays; the width is that of the request


def test_masks_are_pasted_in_order(spark, frame):
    """A later region takes the place of an earlier one where they overlap; alone each is its crop's refined mask."""
    boxes = [(20, 10, 60, 30), (40, 12, 60, 30)]
    each = []
    for x, y, w, h in boxes:
        crop = frame.filter(f"x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h}").selectExpr("image_id", f"y - {y} AS y", f"x - {x} AS x", "r", "g", "b")
        each.append({(r["y"] + y, r["x"] + x): r["v"] for r in k.refined_mask(crop, WIDE, w, h).collect()})
    want = each[0] | each[1]
    got = {(r["y"], r["x"]): r["v"] for r in c.draw_masks(regions(spark, *boxes), WIDE, HIGH, 0, 0, frame).collect()}
    assert len(got) == WIDE * HIGH and all(got[p] == want.get(p, 0) for p in got) and any(want.values())
    drawn = {(r["y"], r["x"]) for r in c.draw_masks(regions(spark, (5, 6, 2, 3), (30, 0, 2, 2)), 20, 12, 1, 2).collect() if r["v"]}
    assert drawn == {(y, x) for y in range(3, 12) for x in range(2, 11)}  # 4..8 by 5..10 with both ends, two more on each side


def test_resizing_by_hand(spark):
    """Twice as wide: the weights at a quarter and three quarters of a sample; the same size changes nothing."""
    row = spark.createDataFrame([(1, 0, x, v) for x, v in enumerate((0, 100, 200, 100))], "image_id long, y long, x long, v long")
    size = spark.createDataFrame([(1, 8, 1)], "image_id long, w long, h long")
    got = {r["x"]: r["v"] for r in c.resize(row, size).collect()}
    # x = 4 lies 1.75, .75, .25 and 1.25 off the four: weights -.0234375, .2265625, .8671875 and -.0703125
    assert got[4] == round(-0.0234375 * 0 + 0.2265625 * 100 + 0.8671875 * 200 - 0.0703125 * 100) == 189
    same = spark.createDataFrame([(1, 4, 1)], "image_id long, w long, h long")
    assert {r["x"]: r["v"] for r in c.resize(row, same).collect()} == {0: 0, 1: 100, 2: 200, 3: 100}
    one = spark.createDataFrame([(1, 1, 1)], "image_id long, w long, h long")
    assert 80 <= c.resize(row, one).first()["v"] <= 130
