"""The ordered folds against plain models, and what must hold for any rectangles."""

import random

import pytest

from quadrille.operators import geometry as g

SCHEMA = "image_id long, ord long, x long, y long, w long, h long"


def iou(a, b):
    w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    return [(i, k, rng.randrange(250), rng.randrange(150), rng.randrange(5, 120), rng.randrange(5, 90)) for i in range(60) for k in range(1, rng.randrange(2, 14))]


def by_image(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def test_dedupe(spark, some):
    kept = by_image(map(tuple, g.dedupe(spark.createDataFrame(some, SCHEMA)).collect()))
    for image, rows in by_image(some).items():
        model = []
        for r in rows:
            if all(iou(r, k) < g.DEDUPE_IOU for k in model):
                model.append(r)
        assert kept[image] == model
    again = g.dedupe(spark.createDataFrame([r for rows in kept.values() for r in rows], SCHEMA))
    assert by_image(map(tuple, again.collect())) == kept


def test_plan_covers_every_region_once(spark, some):
    plan = g.plan_crops(spark.createDataFrame(some, SCHEMA), 320, 200, 200, 150, 4, 4).collect()
    regions = {(r[0], r[1]): r for r in some}
    seen = [(p["image_id"], o) for p in plan for o in p["ords"]]
    assert sorted(seen) == sorted(regions)
    for p in plan:
        assert p["region_count"] == len(p["ords"])
        assert p["region_count"] == 1 or (p["w"] <= 200 and p["h"] <= 150)
        for o in p["ords"]:
            _, _, x, y, w, h = regions[p["image_id"], o]
            assert p["x"] <= max(0, x - 4) and p["y"] <= max(0, y - 4)
            assert p["x"] + p["w"] >= min(320, x + w + 4) and p["y"] + p["h"] >= min(200, y + h + 4)
    for image in {p["image_id"] for p in plan}:
        own = sorted((p["index"], p["y"], p["x"]) for p in plan if p["image_id"] == image)
        assert [o[0] for o in own] == list(range(1, len(own) + 1))
        assert [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_union_area(spark, some):
    areas = {r["image_id"]: r["area"] for r in g.union_area(spark.createDataFrame(some, SCHEMA)).collect()}
    for image, rows in by_image(some).items():
        cells = {(x, y) for _, _, x0, y0, w, h in rows for x in range(x0, x0 + w) for y in range(y0, y0 + h)}
        assert areas[image] == len(cells)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (g.dedupe(none), g.plan_crops(none, 320, 200, 200, 150, 4, 4), g.union_area(none), g.clamp_regions(none, 320, 200), g.bounding_boxes(none)):
        assert df.count() == 0


def test_regions_grow_until_nothing_is_new(spark):
    base = spark.createDataFrame([(1, 1, 0, 0, 20, 20)], SCHEMA)
    step = lambda found: found.selectExpr("image_id", "x + 30 AS x", "y", "w", "h").filter("x < 100")
    found = g.grow_regions(base, step, passes=10, limit=50).collect()
    assert sorted(r["x"] for r in found) == [0, 30, 60, 90]


def planned(rows, most_x, most_y, padding, gap):
    """Groups of an image's regions, one region after the other."""
    groups = []
    for _, k, x, y, w, h in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        held = lambda v, most: max(0, min(most, v))
        a, b, c, d = held(x - padding, 320), held(y - padding, 200), held(x + w + padding, 320), held(y + h + padding, 200)
        fits = []
        for n, ((p, q, r, s), _) in enumerate(groups):
            near = r + gap >= a and c + gap >= p and s + gap >= b and d + gap >= q
            both = min(a, p), min(b, q), max(c, r), max(d, s)
            if near and both[2] - both[0] <= most_x and both[3] - both[1] <= most_y:
                fits.append(((both[2] - both[0]) * (both[3] - both[1]) - (r - p) * (s - q), n, both))
        if fits:
            _, n, both = min(fits)
            groups[n] = both, groups[n][1] + [k]
        else:
            groups.append(((a, b, c, d), [k]))
    order = sorted(range(len(groups)), key=lambda n: (groups[n][0][1], groups[n][0][0], n))
    return [(i, x0, y0, x1 - x0, y1 - y0, len(ords), ords) for i, n in enumerate(order, 1) for (x0, y0, x1, y1), ords in [groups[n]]]


def test_plan_of_images_of_any_size(spark, some):
    rng = random.Random(6)
    rows = some + [(99, k, rng.randrange(300), rng.randrange(180), rng.randrange(1, 60), rng.randrange(1, 40)) for k in range(1, 120)]
    got = g.plan_crops(spark.createDataFrame(rows, SCHEMA).repartition(2), 320, 200, 120, 90, 4, 6).collect()
    for image, own in by_image(rows).items():
        assert sorted(tuple(r)[1:] for r in got if r["image_id"] == image) == planned(own, 120, 90, 4, 6)


def test_put_and_adopt(spark):
    rows = [(1, 1, 0, 0, 9, 9), (1, 2, 5, 5, 9, 9), (2, 1, 1, 1, 4, 4), (None, 1, 0, 0, 3, 3)]
    regions = spark.createDataFrame(rows, SCHEMA)
    edits = [(1, 2, 7, None, 3, 3), (1, 2, 8, 8, 3, 3), (1, None, 6, 6, 2, 2), (1, None, 4, 4, 1, 1), (1, None, 4, 4, 0, 5), (1, 9, 0, 0, 1, 1), (3, None, 2, 2, 5, 5)]
    got = {tuple(r) for r in g.put_region(regions, spark.createDataFrame(edits, SCHEMA)).collect()}
    assert got == {rows[0], rows[2], rows[3], (1, 2, 7, 5, 3, 3), (1, 2, 8, 8, 3, 3), (1, 3, 4, 4, 1, 1), (1, 4, 6, 6, 2, 2), (3, 1, 2, 2, 5, 5)}
    new = [(1, 1, 3, 3, 3, 3), (2, 1, 6, 6, 6, 6), (4, 1, 0, 0, 1, 1), (None, 1, 9, 9, 9, 9)]
    adopted = {tuple(r) for r in g.adopt(regions, spark.createDataFrame(new, SCHEMA)).collect()}
    assert adopted == {rows[0], rows[1], rows[3], *new[1:3]}
