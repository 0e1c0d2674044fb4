"""The analysis of requests on frames: options, masks and counts against plain ones; runs on strips of any height."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import raster as r
from quadrille.operators import runs as u
from quadrille.plans import crops as plans
from quadrille.plans import detect

SF = "/root/testdata/sf0.001"
N = detect.SCENE


def alone(regions):
    from tests.test_detect import iou

    kept = []
    for x in regions:
        if all(iou(x, k) < 0.45 for k in kept):
            kept.append(x)
    return kept


@pytest.fixture(scope="module")
def report(spark):
    return {x["image_id"]: x for x in plans.scene_analysis(spark, SF).collect()}


def test_requests_and_their_options(spark, report):
    base = {}
    for x in sorted(detect.seeds(spark, SF).collect(), key=lambda x: x["ord"]):
        base.setdefault(x["image_id"], []).append((x["x"], x["y"], x["w"], x["h"]))
    assert report.keys() == base.keys()
    detected = {}
    searched = detect.detection(spark, SF).filter("image_id % 3 = 0")
    for x in sorted(searched.collect(), key=lambda x: x["ord"]):
        detected.setdefault(x["image_id"], []).append((x["x"], x["y"], x["w"], x["h"]))
    for i, row in report.items():
        merged = [tuple(m[k] for k in "xywh") for m in json.loads(row["merged_regions"])]
        found = detected[i] if i % 3 == 0 else alone(base[i])
        assert row["family"] == ("propainter" if i % 2 == 0 else "lama") and row["base_region_count"] == len(base[i]) and row["merged_region_count"] == len(merged)
        assert row["suggested_region_count"] == len(json.loads(row["suggested_regions"])) and (i % 3 == 0 or row["suggested_region_count"] == 0)
        if i % 2 or i % 8 >= 4:  # not tightened
            assert merged == found
        crops = json.loads(row["crops"])
        assert row["crop_groups"] == len(crops) == sum(row[s] for s in ("safe", "tight", "risky", "empty")) and (bool(crops) == (i % 2 == 0))
        assert row["crop_area_total"] == sum(c["w"] * c["h"] for c in crops) and sum(c["region_count"] for c in crops) == (len(merged) if crops else 0)
    assert any(row["suggested_region_count"] for row in report.values())


def test_masks_by_engine_and_shape(spark, report):
    red = {}
    for x in detect.scenes(spark, SF).collect():
        red.setdefault(x["image_id"], {})[x["y"], x["x"]] = x["r"]
    seen = set()
    for i, row in report.items():
        pad, wide = i % 4, max(0, i % 3 - 1)
        if i % 5 == 4:  # a model's shape
            on = {p for p, v in red[i].items() if v >= int(min(0.95, max(0.05, i / 40)) * 255)}
        elif i % 4 >= 2:  # rectangles
            on = set()
            for m in json.loads(row["merged_regions"]):
                x0, y0, x1, y1 = max(0, m["x"] - pad), max(0, m["y"] - pad), min(N, m["x"] + m["w"] + pad), min(N, m["y"] + m["h"] + pad)
                on |= {(y, x) for y in range(y0, min(y1, N - 1) + 1) for x in range(x0, min(x1, N - 1) + 1)}
        else:
            continue
        on = {(b, a) for y, x in on for b in range(max(0, y - wide), min(N, y + wide + 1)) for a in range(max(0, x - wide), min(N, x + wide + 1))}
        seen.add(i % 5 == 4)
        assert row["mask_coverage"] == round(len(on) / (N * N) * 100, 3)
        if on:
            assert (row["mask_x0"], row["mask_y0"]) == (min(x for _, x in on), min(y for y, _ in on)) and row["mask_x1"] == max(x for _, x in on) + 1
    assert seen == {True, False}


@pytest.mark.parametrize("strip", [1, 2, 5, 64])
def test_components_do_not_depend_on_strips(spark, strip):
    """Noise, a spiral that winds through all strips, and an empty image."""
    rng = random.Random(1)
    cells = {(1, y, x) for y in range(17) for x in range(23) if rng.random() < 0.4}
    cells |= {(2, y, x) for y in range(0, 17, 2) for x in range(23)} | {(2, y, 22 if y % 4 == 1 else 0) for y in range(1, 17, 2)}
    pixels = spark.createDataFrame([(i, y, x, 255 if (i, y, x) in cells else 0) for i in (1, 2, 3) for y in range(17) for x in range(23)], "image_id long, y long, x long, v long")
    want = {tuple(x) for x in r.label_components(pixels, 23).select("image_id", "y", "x", "label").collect()}
    labels = u.label(u.to_runs(pixels), 23, strip)
    got = {tuple(x) for x in labels.select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "label").collect()}
    assert got == want and len({x[3] for x in got if x[0] == 2}) == 1


def test_runs_of_a_large_frame_take_several_tasks(spark):
    """A frame of 1920 by 1080 in strips: the labels of one image come from more than one task."""
    rows = spark.range(1080).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(18))).alias("k"))
    runs = rows.select("image_id", "y", (F.col("k") * 100).cast("long").alias("x0"), (F.col("k") * 100 + 40).cast("long").alias("x1"))
    stats = u.component_stats(u.label(runs, 1920)).collect()
    assert sorted((x["label"], x["area"], x["w"], x["h"]) for x in stats) == [(100 * k, 40 * 1080, 40, 1080) for k in range(19)]
