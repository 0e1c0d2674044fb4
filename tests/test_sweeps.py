"""Sweeps that are resumed: what a second call adds, and a call that breaks off."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import sweeps as w


def test_a_sweep_is_resumed(spark, tmp_path):
    presets = spark.createDataFrame([(0, "a", "{}"), (1, "b", "{}"), (2, "c", "{}")], "ord long, preset string, options string")
    clips = spark.createDataFrame([("x",), ("y",)], "clip string")
    fails = {("x", "b")}
    seen = []

    def run(todo):
        seen.append(sorted((r["clip"], r["preset"]) for r in todo.collect()))
        bad = F.concat("clip", "preset").isin([c + p for c, p in fails]) if fails else F.lit(False)
        return todo.withColumns({"returncode": F.when(bad, 3).otherwise(0), "elapsed_seconds": F.lit(1.5)})

    path = str(tmp_path / "sweep")
    assert w.read_runs(spark, path) is None and w.latest(spark, path) is None
    assert w.sweep(presets, clips, run, path) == 5  # x stops at b, y runs through
    assert w.sweep(presets, clips, run, path) == 1 and seen[1] == [("x", "b"), ("x", "c")]  # b fails again
    with pytest.raises(RuntimeError):
        w.sweep(presets, clips, lambda todo: (_ for _ in ()).throw(RuntimeError()), path)
    fails.clear()
    assert w.sweep(presets, clips, run, path, start=2) == 1 and seen[2] == [("x", "c")]
    assert w.sweep(presets, clips, run, path) == 1 and w.sweep(presets, clips, run, path) == 0
    assert w.read_runs(spark, path).count() == 8
    last = {(r["clip"], r["preset"]): (r["returncode"], r["call"]) for r in w.latest(spark, path).collect()}
    assert last == {("x", "a"): (0, 0), ("x", "b"): (0, 3), ("x", "c"): (0, 2), ("y", "a"): (0, 0), ("y", "b"): (0, 0), ("y", "c"): (0, 0)}
