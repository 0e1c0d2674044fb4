"""What lets a query outgrow its driver, its disk or its time: broadcasts of pixels, rows that need not be shuffled, joins of cells."""

import contextlib
import inspect
import io
import random

import pyarrow as pa
import pytest

from quadrille import plans
from quadrille.operators import crops, edges, geometry, masks, raster, runs, strokes, templates
from quadrille.sources.shared import by_merge, cut, in_parts

from .test_queries import DATA


@pytest.fixture
def small_broadcasts(spark):
    """A broadcast over 2 MB fails, also those of tables that a query writes on its way."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["crop_compose_feathered", "frame_candidate", "mask_enough", "mask_strengthen", "region_support_mask", "template_mask_scaled", "template_scaled"])
def test_no_pixels_go_through_the_driver(spark, small_broadcasts, name):
    df = plans.queries()[name](spark, str(DATA))
    df.write.format("noop").mode("overwrite").save()


def test_written_tables_join_by_sorting(spark):
    rows = spark.range(1000).selectExpr("id AS image_id", "id % 2 AS v")
    for table in (cut(rows, "rows"), by_merge(rows)):
        assert "SortMergeJoin" in explained(rows.join(table.filter("v > 0").groupBy("image_id").count(), "image_id"))


def test_rectangles_merge_before_they_become_rows(spark):
    rng = random.Random(5)
    boxes = [(i, rng.randrange(-5, 30), rng.randrange(-5, 20), rng.randrange(0, 15), rng.randrange(-3, 12)) for i in range(6) for _ in range(8)]
    boxes += [(9, 0, 0, 3, 4), (9, 4, 2, 2, 5), (9, 0, 0, 3, 4), (10, 50, 50, 5, 5)]
    df = runs.rectangles(spark.createDataFrame(boxes, "image_id long, x long, y long, w long, h long"), 32, 20)
    expected = set()
    for i, x, y, w, h in boxes:
        held = lambda v, most: max(0, min(most, v))
        one, other = held(y, 19), held(y + h, 19)
        expected |= {(i, b, a) for b in range(min(one, other), max(one, other) + 1) for a in range(held(x, 31), held(x + w, 31) + 1)}
    rows = df.collect()
    cells = [(r["image_id"], r["y"], x) for r in rows for x in range(r["x0"], r["x1"])]
    assert len(cells) == len(set(cells)) and set(cells) == expected
    ends = {(r["image_id"], r["y"], r["x1"]) for r in rows}
    assert not [r for r in rows if (r["image_id"], r["y"], r["x0"]) in ends]  # runs that meet are one
    plan = explained(df)
    assert plan.index("Generate") < plan.index("Exchange")


def resized_cells(cells, scale, least):
    """Sums of the cells that there are, by hand."""
    h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
    nh, nw = (max(least, round(n * scale)) for n in (h, w))
    out = {}
    for y in range(nh):
        for x in range(nw):
            py, px = (y + 0.5) * h / nh - 0.5, (x + 0.5) * w / nw - 0.5
            fy, fx = py // 1, px // 1
            for j in (0, 1):
                for k in (0, 1):
                    at = int(max(0, min(h - 1, fy + j))), int(max(0, min(w - 1, fx + k)))
                    if at in cells:
                        out[y, x] = out.get((y, x), 0.0) + cells[at] * (1 - abs(py - fy - j)) * (1 - abs(px - fx - k))
    return out


def test_templates_are_scaled_without_a_join_of_cells(spark):
    whole = {(y, x): float(y * 7 + x * 3 % 5) for y in range(4) for x in range(6)}
    holes = {at: v for at, v in whole.items() if sum(at) % 4 > 0}
    rows = [(1, n, y, x, v) for n, cells in ((1, whole), (2, holes)) for (y, x), v in cells.items()]
    df = templates.scale_templates(spark.createDataFrame(rows, "image_id long, template long, dy long, dx long, t double"), 1.5, 3)
    got = {(r["template"], r["dy"], r["dx"]): r["t"] for r in df.collect()}
    expected = {(n, *at): v for n, cells in ((1, whole), (2, holes)) for at, v in resized_cells(cells, 1.5, 3).items()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    masks = templates.scale_masks(df.selectExpr("image_id", "template", "dy", "dx", "CAST(t > 9 AS INT) AS m").filter("(dy * 3 + dx) % 4 > 0 OR template = 1"), 0.5, 2)
    assert "Join" not in explained(df) + explained(masks)
    given = {k: int(v > 9) for k, v in expected.items() if (k[1] * 3 + k[2]) % 4 > 0 or k[0] == 1}
    for n in (1, 2):
        h, w = (max(k[i] for k in given if k[0] == n) + 1 for i in (1, 2))
        nh, nw = max(2, round(h * 0.5)), max(2, round(w * 0.5))
        near = {(n, y, x): given.get((n, min(h - 1, y * h // nh), min(w - 1, x * w // nw))) for y in range(nh) for x in range(nw)}
        assert {(r["template"], r["dy"], r["dx"]): r["m"] for r in masks.filter(f"template = {n}").collect()} == {k: v for k, v in near.items() if v is not None}


def test_tiles_of_many_images_are_scored_together(spark):
    """A Python call for each tile takes longer than its scores; a batch has tiles and templates of all sizes."""
    rng = random.Random(9)
    images = {i: [[rng.randrange(4) for _ in range(5 + i % 3)] for _ in range(6 - i % 2)] for i in range(12)}
    cells = {(i, n): [[rng.randrange(3) for _ in range(1 + (i + n) % 3)] for _ in range(2 + n)] for i in range(1, 13) for n in range(3)}
    pixels = spark.createDataFrame([(i, y, x, v) for i, rows in images.items() for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y long, x long, v long")
    rows = [(i, n, y, x, v, int((i + y + x) % 4 > 0 or n == 2), n == 1) for (i, n), face in cells.items() for y, row in enumerate(face) for x, v in enumerate(row)]
    df = templates.template_scores(pixels, spark.createDataFrame(rows, "image_id long, template long, dy long, dx long, t long, m int, centred boolean"), tile=2)
    assert "InPandas" not in explained(df)
    want = {}
    for i, n, *_ in {r[:2] for r in rows if r[0] in images}:
        image, face = images[i], [r for r in rows if r[:2] == (i, n) and r[5]]
        for y in range(len(image) - len(cells[i, n]) + 1):
            for x in range(len(image[0]) - len(cells[i, n][0]) + 1):
                pairs = [(image[y + r[2]][x + r[3]], r[4]) for r in face]
                a, b = ([p[k] - (sum(q[k] for q in pairs) / len(pairs) if n == 1 else 0) for p in pairs] for k in (0, 1))
                vv, tt = sum(v * v for v in a), sum(t * t for t in b)
                want[i, n, y, x] = sum(v * t for v, t in zip(a, b)) / (vv * tt) ** 0.5 if min(vv, tt) > 1e-6 else 0.0
    got = {tuple(r)[:4]: r["score"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_many_images_are_labelled_together(spark):
    """No Python call for each image or strip; what touches stays within its image, over any number of strips."""
    rng = random.Random(4)
    lit = {(i * 7 - 20, y, x) for i in range(8) for y in range(9) for x in range(6) if rng.random() < 0.4}
    pixels = spark.createDataFrame([(*at, 255) for at in lit], "image_id long, y long, x long, v long")
    want = {}
    for at in sorted(lit):
        reach, new = {at}, [at]
        while new and at not in want:
            i, y, x = new.pop()
            near = {(i, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & lit - reach
            reach |= near
            new += near
        for p in reach if at not in want else ():
            want[p] = at[1] * 6 + at[2]
    whole = raster.label_components(pixels, 6)
    assert {tuple(r)[:3]: r["label"] for r in whole.collect()} == want
    assert "InPandas" not in explained(whole)
    assert "applyInPandas" not in inspect.getsource(runs.label)  # its plan ends at a written table
    for strip in (2, 3, 128):
        rows = runs.label(runs.to_runs(pixels), 6, strip).collect()
        assert {(r["image_id"], r["y"], x): r["label"] for r in rows for x in range(r["x0"], r["x1"])} == want


def test_hits_of_an_image_are_counted_and_spread_in_one_part(spark):
    """One shuffle for votes and windows, into the parts that are set: a scan keeps no votes, and no few large tasks sort them."""
    hits = spark.range(2000).selectExpr("id % 10 AS image_id", "id div 10 % 20 AS y", "id div 200 AS x", "0 AS frame", "id % 3 = 0 AS hit")
    plan = explained(masks.voted(hits, 1, 0.05, 0.6, 1))
    assert "(y" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange")


@pytest.fixture
def large_table(spark, tmp_path, monkeypatch):
    """Lines of orders that fill more parts than there are cores, as those of a large table do."""
    monkeypatch.setattr("quadrille.sources.shared.PART_ROWS", 20)
    rng = random.Random(8)
    lines = [(i, rng.randrange(200), rng.randrange(50), n, float(rng.randrange(1, 50)), rng.random() * 1000, 0.01, 0.02, "R", "O", None) for i in range(60) for n in range(1, rng.randrange(2, 8))]
    types = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, types).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(80).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path), -(-len(lines) // 20)


@pytest.mark.parametrize("name", ["mask_coverage_label", "region_upsert", "region_union_area", "crop_group_plan"])
def test_regions_lie_in_as_many_parts_as_their_rows_fill(spark, large_table, name):
    """No part grows with the table, and what follows by image shuffles no region again."""
    data, parts = large_table
    plan = explained(plans.queries()[name](spark, data))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line and f", {parts})" in line for line in exchanges)


def test_images_without_regions_move_to_the_parts_of_regions(spark, large_table):
    data, parts = large_table
    plan = explained(plans.queries()["region_boxes"](spark, data))
    assert "hashpartitioning(l_orderkey#" in plan and f", {parts}), REPARTITION_BY_NUM" in plan


def test_small_tables_stay_in_their_parts(spark):
    df = spark.range(100)
    assert "Exchange" not in explained(in_parts(df, "id"))


@pytest.mark.parametrize("name", ["crop_group_plan", "region_dedupe_greedy", "region_union_area", "regions_adopt"])
def test_folds_run_once_in_batches(spark, large_table, name):
    assert explained(plans.queries()[name](spark, large_table[0])).count("ArrowEvalPython") == 1


def test_boxes_and_their_mask_are_shuffled_once(spark):
    """Planning is not done again for what the mask leaves free."""
    regions = spark.createDataFrame([(1, 1, 5, 5, 30, 30)], "image_id long, ord long, x long, y long, w long, h long")
    points = spark.createDataFrame([(1, 8, 9)], "image_id long, px long, py long")
    boxes = geometry.plan_crops(regions, 320, 200, 200, 150, 4, 4).selectExpr("*", "x + w AS x1", "y + h AS y1")
    plan = explained(raster._with_held(boxes, points, "x", "y", "x1", "y1"))
    assert plan.count("Exchange") == 3 and plan.count("ArrowEvalPython") == 1  # regions, groups and points


def test_pixels_of_frames_are_made_in_the_parts_that_are_set(spark):
    """What Spark merges into one task are the images, whose pixels that task would then make alone."""
    images = spark.range(50).selectExpr("id % 20 AS image_id").distinct()
    for band in (strokes.wide_band, strokes.text_band, strokes.text_core):
        df = band(images, 40, 24)
        assert df.selectExpr("spark_partition_id() AS part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def noise(spark, images=6, side=12):
    rng = random.Random(3)
    return spark.createDataFrame([(i, y, x, rng.randrange(256)) for i in range(images) for y in range(side) for x in range(side)], "image_id long, y long, x long, v long")


def edges_of(df):
    return {tuple(r)[:3] for r in df.collect() if r["v"]}


def test_edges_take_one_shuffle_into_parts_that_grow(spark, monkeypatch):
    """No pixel is joined, and what a task sorts doesn't grow with the table."""
    want = edges_of(edges.canny(noise(spark), 200, 600, 12))
    monkeypatch.setattr("quadrille.sources.shared.PART_ROWS", 50)
    monkeypatch.setattr("quadrille.operators.raster.SLAB", 100)
    drawn = edges.canny(noise(spark), 200, 600, 12)
    plan = explained(drawn)
    assert plan.count("Exchange") == 1 and f", {-(-6 * 144 // 50)}), REPARTITION_BY_NUM" in plan and "Join" not in plan
    assert want and edges_of(drawn) == want


def test_surfaces_take_one_shuffle_into_parts_that_grow(spark, monkeypatch):
    monkeypatch.setattr("quadrille.sources.shared.PART_ROWS", 50)
    rgb = noise(spark).selectExpr("image_id", "y", "x", "CAST(v AS double) AS r", "CAST(v * 7 % 256 AS double) AS g", "CAST(v * 3 % 256 AS double) AS b")
    plan = explained(strokes.match_surface(rgb, 12))
    assert plan.count("Exchange") == 1 and f", {-(-6 * 144 // 50)}), REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_pixels_without_an_image_have_no_edges(spark):
    pixels = noise(spark, 2).selectExpr("CASE WHEN image_id = 0 THEN image_id END AS image_id", "y", "x", "v")
    rows = edges.canny(pixels, 200, 600, 12).collect()
    assert len(rows) == 288 and {r["image_id"] for r in rows if r["v"]} == {0}


@pytest.mark.parametrize("rows", [1, 4, 100])
def test_batches_are_put_together_to_whole_images(rows):
    images = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4, 7]
    for size in (1, 2, 5, 14):
        batches = [pa.RecordBatch.from_pydict({"image_id": images[i : i + size]}) for i in range(0, len(images), size)]
        got = [b.column("image_id").to_pylist() for b in raster.whole_images([*batches, batches[0].slice(0, 0)], rows)]
        assert sum(got, []) == images and not any(set(a) & set(b) for i, a in enumerate(got) for b in got[i + 1 :])
        assert all(len(b) >= rows for b in got[:-1]) and (rows > 1 or size > 1 or len(got) == 5)


def test_regions_are_refined_without_a_join_of_pixels_in_parts_that_grow(spark, monkeypatch):
    """Pixels carry what is told of their image and their region; each step's parts follow its own rows."""
    monkeypatch.setattr("quadrille.sources.shared.PART_ROWS", 50)
    rgb = noise(spark, 3).selectExpr("image_id", "y", "x", *[f"CAST(v * {k} % 256 AS double) AS {c}" for k, c in ((1, "r"), (7, "g"), (3, "b"))])
    regions = spark.createDataFrame([(i, n, n * 2, 1, 6, 5) for i in range(3) for n in (1, 2)], "image_id long, ord long, x long, y long, w long, h long")
    boxes = regions.withColumn("crop", regions.image_id * 2 + regions.ord)
    plan = explained(crops.cut_out(rgb, boxes))
    parts = f", {-(-3 * 144 // 50)}), REPARTITION_BY_NUM"
    assert plan.count("Exchange") == plan.count(parts) == 2
    for df, rows in ((strokes.refined_mask(rgb, 12), 432), (crops.draw_masks(regions, 12, 12, 1, 1, rgb), 432 + 6 * 8 * 7)):
        plan = explained(df)
        assert "Join" not in plan and plan.count("Exchange") - plan.count("ENSURE_REQUIREMENTS") == 1 and "REPARTITION_BY_NUM" in plan
        assert f", {-(-rows // 50)}), REPARTITION_BY_NUM" in plan


def test_components_of_pixels_have_their_sizes(spark):
    lit = {(0, 0, 0), (0, 1, 1), (0, 1, 4), (0, 2, 4), (1, 0, 5), (1, 1, 0)}
    pixels = spark.createDataFrame([(i, y, x, 255 * ((i, y, x) in lit)) for i in range(3) for y in range(3) for x in range(6)], "image_id long, y long, x long, v long")
    got = {tuple(r)[:3]: (r["area"], r["w"], r["h"]) for r in raster.with_component(pixels.repartition(2, "image_id"), "v", 6).collect()}
    want = {(0, 0, 0): (2, 2, 2), (0, 1, 1): (2, 2, 2), (0, 1, 4): (2, 1, 2), (0, 2, 4): (2, 1, 2), (1, 0, 5): (1, 1, 1), (1, 1, 0): (1, 1, 1)}
    assert len(got) == 54 and {k: v for k, v in got.items() if v != (0, 0, 0)} == want
