"""Masks of crops worked off in batches: the same as the rules on relations of pixels, with one shuffle."""

import random

from quadrille import plans
from quadrille.operators import masks as m

from .test_size import explained

HIGH, WIDE = 18, 26


def test_crops_are_shuffled_once_into_parts_that_grow(spark, tmp_path, monkeypatch):
    """No table is written between the masks, and no pixel is joined with another."""
    monkeypatch.setattr("quadrille.sources.shared.PART_ROWS", 1000)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(64)]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = plans.queries()["mask_steady_or_fallback"](spark, str(tmp_path))
    plan = explained(df)
    dealt = f", {-(-30 * 256 // 1000)}), REPARTITION_BY_NUM"
    assert plan.count("FileScan") == 2  # for pixels, and for the crops' regions
    assert plan.count(dealt) == 2 and plan.count("SortMergeJoin") == 1 and plan.count("MapInArrow") == 1  # pixels, and a row a crop
    assert plan.count("Exchange") - plan.count("REPARTITION_BY_NUM") <= 1 and "Window" not in plan
    assert df.count() == 30 * 256


def test_batches_give_what_relations_give(spark):
    """Crops of many kinds: noise, letters, flat ones, empty masks, regions within, at the edge of and beyond the crop."""
    rng = random.Random(7)
    rows, boxes = [], []
    for i in range(24):
        bars = {(y, x) for k in range(3) for y in range(5 + k, 12) for x in (4 + 6 * k, 5 + 6 * k)}
        lit = [set(), bars, {at for at in bars if rng.random() < 0.8}, {(y, x) for y in range(HIGH) for x in range(WIDE) if rng.random() < 0.3}]
        steady, model, face = lit[i % 4], lit[i // 4 % 4], lit[(i + i // 8) % 4]
        for y in range(HIGH):
            for x in range(WIDE):
                v = 60 + x + 150 * ((y, x) in face) + rng.randrange(12 if i % 3 else 60)
                rows.append((i, y, x, float(min(255, v)), float(min(255, v + i)), float(max(0, v - 8)), 255 * ((y, x) in steady), 255 * ((y, x) in model)))
        boxes.append((i, 1, i * 3 % 40 - 6, i * 5 % 24 - 4, 1 + i % 9, 1 + i % 5))
    crops = spark.createDataFrame(rows, "image_id long, y long, x long, r double, g double, b double, steady long, model long").repartition(3)
    regions = spark.createDataFrame(boxes, "image_id long, ord long, x long, y long, w long, h long")
    got = {tuple(r)[:3]: r["v"] for r in m.steady_or_fallback(crops, regions, WIDE, WIDE, HIGH).collect()}
    layer = lambda c: m.cut(crops.select("image_id", "y", "x", crops[c].alias("v")), c)
    fused = m.cut(m.fuse_guarded(layer("steady"), layer("model"), WIDE, WIDE, HIGH), "fused")
    want = m.joined_fallback(fused, m.fallback(m.cut(crops.select("image_id", "y", "x", "r", "g", "b"), "rgb"), regions, WIDE, WIDE, HIGH), WIDE, HIGH)
    assert got == {tuple(r)[:3]: r["v"] for r in want.collect()}
    assert len(got) == len(rows) and len({tuple(v for (j, *_), v in sorted(got.items()) if j == i) for i in range(24)}) > 4
