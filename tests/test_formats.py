"""Collections as Spark formats."""

import struct

import numpy as np
import pytest

from matchbench.operators import meshes
from matchbench.sources import formats, images

HEAD = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar diffuse_red\nproperty uchar diffuse_green\nproperty uchar diffuse_blue\n"


def ply(points, faces=(), colour="300 20 -1"):
    head = HEAD.format(len(points)) + (f"element face {len(faces)}\nproperty list uchar int vertex_indices\n" if len(faces) else "") + "end_header\n"
    return head + "".join(f"{x} {y} {z} {colour}\n" for x, y, z in points) + "".join(f"{len(f)} {' '.join(map(str, f))}\n" for f in faces)


@pytest.fixture(scope="module")
def source(spark):
    formats.register(spark)
    return lambda name, path, **o: spark.read.format(name).options(**o).load(str(path))


@pytest.fixture(scope="module")
def lights(tmp_path_factory):
    root = tmp_path_factory.mktemp("lights")
    for n in (1, 2):
        (root / f"yaleB0{n}").mkdir()
        for light in ("P00A+000E+00", "P03A-010E+20", "P00_Ambient"):
            (root / f"yaleB0{n}" / f"yaleB0{n}_{light}.pgm").write_bytes(b"P5\n6 4\n255\n" + bytes(24))
    (root / "yaleB02" / "yaleB02_left.png").write_bytes(images.encode_png(np.zeros((3, 5))))
    (root / "yaleB02" / "yaleB02_broken.png").write_bytes(b"nothing")
    (root / "notes.txt").write_text("-")
    return root


@pytest.fixture(scope="module")
def scans(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    (root / "TD_3D").mkdir()
    for n in (1, 7):
        (root / "TD_3D" / f"TD_3D_{n}.ply").write_text(ply([(0, 0, n), (1, 0, 2), (0, 1, 3), (1, 1, 4)], [(0, 1, 3, 2)]))
    for n, es in ((1, (1, 5)), (7, (2, 9)), (8, (1,))):
        (root / "TD_RGB_E" / str(n)).mkdir(parents=True)
        for e in es:
            (root / "TD_RGB_E" / str(n) / f"TD_RGB_E_{e}.png").write_bytes(images.encode_png(np.zeros((2, 3))))
    return root


def test_photos_under_lights(source, lights):
    rows = {r["sample_id"]: r for r in source("yaleb", lights).collect()}
    assert set(rows) == {"S001_yaleB01_P00A+000E+00", "S001_yaleB01_P03A-010E+20", "S002_yaleB02_P00A+000E+00", "S002_yaleB02_P03A-010E+20", "S002_yaleB02_left"}
    a, b = rows["S001_yaleB01_P03A-010E+20"], rows["S002_yaleB02_left"]
    assert (a["illumination"], a["pose_yaw"], a["orig_w"], a["orig_h"], a["n_points"], a["notes"]) == ("yale:A-010E+20", 3.0, 6, 4, 468, "native_light=P03A-010E+20;azimuth=-10;elevation=20")
    assert (b["illumination"], b["orig_w"], b["orig_h"], b["has_2d"], b["has_3d"]) == ("yale:left", 5, 3, True, False)
    assert rows["S001_yaleB01_P00A+000E+00"]["illumination"] == "normal"


def test_meshes_and_photos(source, scans):
    rows = {r["sample_id"]: r for r in source("tufts3d", scans, filesPerSplit=2).collect()}
    assert set(rows) == {"S001_3d", "S001_neutral", "S001_sunglasses", "S007_3d", "S007_smile", "S007_expr_9"}  # participant 8 has no mesh
    assert rows["S001_3d"]["n_points"] == 4 and rows["S001_3d"]["path_2d"] is None and rows["S001_sunglasses"]["occlusion"] == "sunglasses"
    assert (rows["S007_smile"]["orig_w"], rows["S007_smile"]["has_3d"], rows["S007_smile"]["n_points"]) == (3, False, None)


def test_options_keep_files_closed(source, scans, tmp_path):
    """A malformed mesh fails a scan only where it's asked for."""
    import shutil

    root = tmp_path / "scans"
    shutil.copytree(scans, root)
    (root / "TD_3D" / "TD_3D_9.ply").write_text("spoilt")
    ids = lambda **o: {r["sample_id"] for r in source("tufts3d", root, **o).collect()}
    assert ids(subject_id="S007") == {"S007_3d", "S007_smile", "S007_expr_9"} and ids(subject_id="S001,S007", has_3d="true") == {"S001_3d", "S007_3d"}
    assert ids(has_2d="true", expression="neutral") == {"S001_neutral"} and ids(subject_id="S404") == set()
    with pytest.raises(Exception, match="not a PLY file"):
        ids()


def test_filters_of_one_scan_leave_others_whole(source, scans):
    t = source("tufts3d", scans)
    one = t.where("subject_id = 'S001'")
    assert one.count() == 3 and t.count() == 6 and t.union(one).count() == 9


def test_vertices_and_faces(source, scans):
    v, f = source("ply", scans), source("ply", scans, element="face")
    one = f"{scans}/TD_3D/TD_3D_7.ply"
    assert v.count() == 8 and [tuple(r)[1:] for r in v.where(v.path == one).orderBy("vertex").collect()][0] == (0, 0.0, 0.0, 7.0, 255, 20, 0)
    assert sorted(tuple(r)[1:] for r in f.where(f.path == one).collect()) == [(0, 0, 1, 3), (1, 0, 3, 2)]
    depth = meshes.interpolate(v.withColumnRenamed("path", "sample_id"), f.withColumnRenamed("path", "sample_id"), 2, 0.0, 1.0)
    assert {(r["y"], r["x"]): r["z"] for r in depth.where(depth.sample_id == one).collect()} == {(0, 0): 7.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}


def test_meshes_larger_than_a_batch(source, tmp_path):
    n = formats.BATCH * 2 + 5
    (tmp_path / "big.PLY").write_text(ply([(i, 0, 0) for i in range(n)]))
    v = source("ply", tmp_path)
    assert v.count() == n and v.where("px <> vertex").count() == 0 and source("ply", tmp_path, element="face").count() == 0


@pytest.mark.parametrize(("text", "error"), [
    ("ply\nformat binary_little_endian 1.0\nend_header\n", "binary"), ("ply\nformat ascii 1.0\n", "doesn't end"), ("off\n", "not a PLY"),
    (HEAD.format(2) + "end_header\n0 0 0 1 1 1\n", "ends before"), (HEAD.format(1) + "end_header\n0 0\n", "malformed"),
])
def test_malformed_meshes(source, tmp_path, text, error):
    (tmp_path / "x.ply").write_text(text)
    with pytest.raises(Exception, match=error):
        source("ply", tmp_path).collect()


def test_folders_without_captures(source, tmp_path):
    with pytest.raises(Exception, match="no captures"):
        source("yaleb", tmp_path).count()
    assert source("ply", tmp_path).count() == 0


def test_sizes_from_heads():
    assert images.size(b"BM" + bytes(16) + struct.pack("<ii", 7, -9)) == (7, 9)
    assert images.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x08\x03") == (8, 5)
    assert images.size(b"P6 # note\n10 20\n255\n") in ((10, 20), None) and images.size(b"") is None
