"""Files: cameras, image folders, dimensions, points; detectors."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vertexmill.plans import fixtures as fx
from vertexmill.sources import readers, writers

PINHOLE = """<?xml version="1.0" encoding="utf-8"?>
<camera>
  <model>pinhole_radtan</model>
  <image_width>1920</image_width><image_height>1080</image_height>
  <intrinsics><fx>1000.0</fx><fy> 1e3 </fy><cx>960.0</cx><cy>540.0</cy></intrinsics>
  <distortion><k1>-0.1</k1><k2>0.02</k2><p1>0.0</p1><p2>0</p2><k3>.5</k3></distortion>
</camera>
"""
OMNI = PINHOLE.replace("pinhole_radtan", "omni_radtan").replace("  <distortion>", "  <omni><xi>1.0</xi></omni>\n  <distortion>")


def test_camera_files(spark, tmp_path):
    files = {
        "pin.xml": PINHOLE, "omni one.xml": OMNI, "a+b%20c.xml": PINHOLE, "short.xml": "<camera><model>pinhole_radtan</model></camera>", "nomodel.xml": PINHOLE.replace("<model>pinhole_radtan</model>", ""),
        "unknown.xml": PINHOLE.replace("pinhole_radtan", "unknown"), "noxi.xml": PINHOLE.replace("pinhole_radtan", "omni_radtan"), "empty_fx.xml": PINHOLE.replace("1000.0", " "),
        "word.xml": PINHOLE.replace("1000.0", "wide"), "half.xml": PINHOLE.replace("1920", "1920.5"), "flat.xml": PINHOLE.replace("1080", "0"), "back.xml": PINHOLE.replace("1000.0", "-1"),
        "two.xml": PINHOLE + OMNI.split("?>")[1], "none.xml": "<lens/>", "nothing.xml": "", "torn.xml": PINHOLE[:200], "crossed.xml": PINHOLE.replace("</cx>", "</cy>"), "nodist.xml": PINHOLE.replace("distortion>", "other>"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    valid, rejected = readers.read_cameras(spark, str(tmp_path))
    good = {r.camera_id: r for r in valid.collect()}
    assert good.keys() == {"pin.xml", "omni one.xml", "a+b%20c.xml"}
    p, o = good["pin.xml"], good["omni one.xml"]
    assert (p.model, p.image_width, p.image_height, p.fx, p.fy, p.cx, p.cy, p.xi, p.k1, p.k2, p.p1, p.p2, p.k3) == ("pinhole_radtan", 1920, 1080, 1000.0, 1000.0, 960.0, 540.0, None, -0.1, 0.02, 0.0, 0.0, 0.5)
    assert (o.model, o.xi, o.k3) == ("omni_radtan", 1.0, 0.5)
    reasons = {r.camera_id: r.reason for r in rejected.collect()}
    want = {
        "short.xml": "missing field: image_width", "nomodel.xml": "missing field: model", "unknown.xml": "unknown camera model: unknown", "noxi.xml": "missing field: xi", "empty_fx.xml": "missing field: fx",
        "word.xml": "not a number: fx", "half.xml": "not a number: image_width", "flat.xml": "image_height must be positive", "back.xml": "fx must be positive", "two.xml": "several <camera> elements", "nodist.xml": "missing field: k1",
        "none.xml": "no <camera> element",
    }
    assert {k: reasons.get(k) for k in want} == want and reasons.keys() == files.keys() - good.keys() - {"nothing.xml"} and all(reasons.values())
    single, none = readers.read_cameras(spark, str(tmp_path / "pin.xml"))
    assert [r.camera_id for r in single.collect()] == ["pin.xml"] and none.count() == 0
    seen = fx.poses(spark, "/root/testdata/sf0.001").limit(5).withColumn("camera_id", F.lit("pin.xml")).withColumn("point", F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    from vertexmill.functions import cameras as cam

    assert {tuple(r.pixel) for r in cam.project(seen, valid).collect()} == {(960.0, 540.0)}


def _png(width, height):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\7" * 3 * width) * height)) + part(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    sizes = {"plain.png": (5, 3), "with space.png": (7, 2), "p%20c.PNG": (4, 6), "plus+and%2B.png": (1, 9), "é漢.png": (8, 8), "q?x#y&z=1.png": (2, 3), "[a]{b}.png": (3, 3)}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(_png(*size))
    for name in ("broken.jpg", "Upper.JPEG", "a.bmp", "b.tif", "c.TIFF"):
        (tmp_path / name).write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "png").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "inner.png").write_bytes(_png(1, 1))
    scan = readers.scan_images(spark, str(tmp_path))
    rows = {r.rel_path: r for r in scan.collect()}
    assert rows.keys() == sizes.keys() | {"broken.jpg", "Upper.JPEG", "a.bmp", "b.tif", "c.TIFF"}
    assert all(rows[n].size_bytes == (tmp_path / n).stat().st_size and rows[n].mtime_ms == (tmp_path / n).stat().st_mtime_ns // 10**6 for n in rows)
    got = {r.rel_path: (r.width, r.height) for r in readers.with_dimensions(scan, str(tmp_path)).collect()}
    assert got == dict.fromkeys(rows, (None, None)) | sizes


def test_detector(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"i{k}.png").write_bytes(b"%d" % k)

    def detector(content):
        k = int(content)
        if k == 3:
            raise ValueError("cannot read it")
        return [(m, [(m + 0.5, 0.0), (1.0, 2.0), (3.0, 4.0), (5.0, float(k))]) for m in range(k)]

    rows = sorted([(r.path[-6:], r.marker_id, r.corners and [tuple(c) for c in r.corners], r.error) for r in readers.detect(spark, str(tmp_path), detector).collect()], key=str)
    corners = lambda m, k: [(m + 0.5, 0.0), (1.0, 2.0), (3.0, 4.0), (5.0, float(k))]
    assert rows == [("i1.png", 0, corners(0, 1), None), ("i2.png", 0, corners(0, 2), None), ("i2.png", 1, corners(1, 2), None), ("i3.png", None, None, "cannot read it")]


def test_point_file(spark, tmp_path):
    points = spark.createDataFrame([(3, 0.5, 1.25, -2.0, True), (1, 1.0, 2.0, 3.0, True), (2, 9.0, 9.0, 9.0, False)], "point_id long, x double, y double, z double, is_active boolean").repartition(3)
    writers.export_point_cloud(points, str(tmp_path / "cloud"))
    lines = [x for f in sorted((tmp_path / "cloud").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x != "x,y,z"] == ["1.0,2.0,3.0", "0.5,1.25,-2.0"] and lines[0] == "x,y,z"
    with pytest.raises(ValueError, match="no marker poses"):
        writers.export_marker_map(spark.createDataFrame([], "marker_id long, T struct<R:array<array<double>>,t:array<double>>"), 1.0, str(tmp_path / "none"))
