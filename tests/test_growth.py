"""Growth of regions: all of an image's regions, in one shuffle."""

import random

import numpy as np
import pytest

from quadrille import plans
from quadrille.operators import geometry as g
from quadrille.operators.growth import grow
from quadrille.sources.tables import HEIGHT, WIDTH, regions

from .test_detect import grown
from .test_size import explained, large_table  # noqa: F401


def by_image(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(r["image_id"], []).append((r["x"], r["y"], r["w"], r["h"]))
    return out


def test_all_regions_of_an_image_grow(spark, large_table):  # noqa: F811
    base = by_image(g.clamp_regions(regions(spark, large_table[0]), WIDTH, HEIGHT).collect())
    got = by_image(plans.queries()["region_growth"](spark, large_table[0]).collect())

    def match(r):
        return [(r[0] + m, *r[1:], 0.9 - m / 1000) for m in (40, 80) if r[0] + m + r[2] <= WIDTH]

    assert max(map(len, base.values())) > 4
    assert got == {i: grown(rs, match, WIDTH, HEIGHT) for i, rs in base.items()}


def test_passes_shuffle_and_write_nothing(spark, large_table):  # noqa: F811
    data, parts = large_table
    plan = explained(plans.queries()["region_growth"](spark, data))
    assert plan.count("Exchange") == 1 and f", {parts}), REPARTITION_BY_NUM" in plan and plan.count("ArrowEvalPython") == 1
    assert plan.count("FileScan") == 1 and "[l_orderkey" in plan  # no table is written on the way and read again


@pytest.mark.parametrize("seed", range(3))
def test_growth_with_matches_of_many_kinds(spark, seed):
    """Scores above a seed's, equal scores, copies of a region, regions that go when they are clamped, images that reach their limit."""
    rng = random.Random(seed)
    base = {}
    for i in range(120):
        own = [(rng.randrange(-8, 90), rng.randrange(-8, 60), rng.randrange(3, 14), rng.randrange(3, 12)) for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 15]))]
        base[i] = own + own[:1] if i % 6 == 0 else own
    moves = [(rng.randrange(-30, 30), rng.randrange(-20, 20), rng.choice([0.5, 0.7, 0.9, 1.0, 1.2])) for _ in range(4)]

    def match(r):
        return [(r[0] + dx, r[1] + dy, r[2], r[3], s) for k, (dx, dy, s) in enumerate(moves) if (r[0] + r[1] * 3 + k) % 3]

    def match_all(x, y, w, h):
        of, nth = np.divmod(np.arange(len(x) * 4), 4)
        dx, dy, s = np.array(moves).T
        there = (x[of] + y[of] * 3 + nth) % 3 > 0
        of, nth = of[there], nth[there]
        return of, (x[of] + dx[nth]).astype(int), (y[of] + dy[nth]).astype(int), w[of], h[of], s[nth]

    rows = [(i, n, *r) for i, rs in base.items() for n, r in enumerate(rs, 1)]
    df = grow(spark.createDataFrame(rows, "image_id long, ord long, x long, y long, w long, h long"), match_all, 100, 70)
    got = df.collect()
    assert by_image(got) == {i: grown(rs, match, 100, 70) for i, rs in base.items()}
    assert any(r["suggested"] for r in got) and all(not r["suggested"] or r["ord"] > len(base[r["image_id"]]) for r in got)
