import random

from quadrille.operators import raster as r
from quadrille.operators.graph import components

SCHEMA = "image_id long, y long, x long, v long"


def grid(seed, side=9, share=0.3):
    rng = random.Random(seed)
    return [(1, y, x, 255 if rng.random() < share else 0) for y in range(side) for x in range(side)]


def test_dilate_and_integral(spark):
    cells = grid(1)
    value = {(y, x): v for _, y, x, v in cells}
    df = spark.createDataFrame(cells, SCHEMA)
    for k in (0, 1, 2):
        for row in r.dilate(df, k).collect():
            around = [value.get((row["y"] + a, row["x"] + b), 0) for a in range(-k, k + 1) for b in range(-k, k + 1)]
            assert row["v"] == max(around)
    for row in r.integral(df).collect():
        assert row["s"] == sum(v for (y, x), v in value.items() if y <= row["y"] and x <= row["x"])


def test_components(spark):
    cells = grid(2, share=0.4)
    on = {(y, x) for _, y, x, v in cells if v}
    expected, left = {}, set(on)
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        expected |= dict.fromkeys(part, min(y * 9 + x for y, x in part))
    got = {(q["y"], q["x"]): q["label"] for q in r.label_components(spark.createDataFrame(cells, SCHEMA), 9).collect()}
    assert got == expected


def test_graph_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (5, 6)], "a long, b long")
    roots = {q["node"]: q["root"] for q in components(chain).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
