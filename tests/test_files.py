import json

from quadrille.operators import geometry, reports
from quadrille.sources import files
from quadrille.sources.shared import cut


def test_regions_presets_and_options(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": 2, "w": 30, "h": 40}, {"x": "12.5", "y": 0, "w": 9, "h": 9}, {"y": 1}, {"x": 7, "y": 7, "w": 8, "h": 9}], indent=1))
    raw = files.region_file(spark, str(tmp_path / "a.json"))
    assert raw.count() == 4
    assert [(r["ord"], r["x"], r["w"]) for r in geometry.normalize(raw).orderBy("ord").collect()] == [(1, 1, 30), (4, 7, 8)]
    (tmp_path / "p.json").write_text(json.dumps([{"name": "a", "options": {"skip": 2}}, {"name": "b"}]))
    assert [(r["ord"], r["name"], r["options"]) for r in files.preset_file(spark, str(tmp_path / "p.json")).orderBy("ord").collect()] == [(0, "a", {"skip": "2"}), (1, "b", None)]
    (tmp_path / "o.json").write_text('{"skip": 3, "mask_shape": "auto"}')
    assert dict(map(tuple, files.option_file(spark, str(tmp_path / "o.json")).collect())) == {"skip": "3", "mask_shape": "auto"}


def test_folders(spark, tmp_path):
    (tmp_path / "clip").mkdir()
    for n in (1, 2, 10):
        (tmp_path / "clip" / f"{n:06d}.png").write_bytes(bytes([n, n + 1]))
    (tmp_path / "clip" / "cover.png").write_bytes(b"x")
    frames = files.frame_folder(spark, str(tmp_path))
    assert sorted((r["video_id"], r["n"]) for r in frames.select("video_id", "n").collect()) == [("clip", 1), ("clip", 2), ("clip", 10)]
    pixels = files.decoded(frames, lambda b: [{"x": k, "v": v} for k, v in enumerate(b)], "x long, v long", ["video_id", "n"])
    assert sorted((r["n"], r["x"], r["v"]) for r in pixels.collect()) == [(n, k, n + k) for n in (1, 2, 10) for k in (0, 1)]
    assert files.file_catalog(spark, str(tmp_path / "clip"), "0*").count() == 3


def test_reports_are_written(spark, tmp_path):
    runs = spark.createDataFrame([(0, 1.5, 3, 9.25, 1, 0)], "offset long, mask_coverage double, crop_groups long, crop_area_pct double, risky_groups long, empty_groups long")
    files.write_manifest(runs, str(tmp_path / "m"))
    files.write_report(reports.sweep_markdown(runs), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    assert "| `0s` | `1.500` | `3` | `9.250` | `1` | `0` |" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect())
    options = spark.createDataFrame([(1, "Resize", 1024)], "request_id long, hd_strategy string, resize_limit long")
    assert json.loads(files.painter_config(options).first()["json"]) == {"hd_strategy": "Resize", "hd_strategy_resize_limit": 1024}


def test_shared_table_is_read_back(spark):
    df = spark.range(5)
    assert sorted(r["id"] for r in cut(df, "five").collect()) == [0, 1, 2, 3, 4]
