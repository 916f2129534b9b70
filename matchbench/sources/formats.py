"""Collections as Spark formats: ``spark.read.format("yaleb" | "tufts3d" | "ply").load(path)`` after ``register(spark)``.

A reader lists the folder, reads all it can from names, and deals the files in splits; of a photo tasks read only the head.
Options named like a column in ``NAMED``, with values between commas (``subject_id="S001,S007"``, ``has_3d="true"``), keep all
other files closed. Filters aren't pushed down by themselves: Spark 4.1 keeps a Python reader's pushed filters for later scans
of the same DataFrame that have none, so rows would be lost. Paths are those of any file system that Arrow knows. A
folder without captures is an error; photos whose size can't be told are left out.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import images
from .files import EXPRESSIONS

CAPTURES = (
    "dataset string, subject_id string, sample_id string, session string, path_2d string, path_3d string, expression string, pose_yaw double, pose_pitch double, "
    "illumination string, occlusion string, orig_w int, orig_h int, n_points int, has_2d boolean, has_3d boolean, notes string"
)
COLUMNS = [x.split()[0] for x in CAPTURES.split(", ")]
#: Columns that names alone tell, and that options may name.
NAMED = frozenset(COLUMNS) - {"path_2d", "path_3d", "orig_w", "orig_h", "n_points", "notes"}
#: Points of a photo's face mesh, a fixed value; bytes in which a photo's size is looked for; rows of a batch.
FACE_POINTS, HEAD, BATCH = 468, 1 << 18, 65_536
_PHOTO = re.compile(r"\.(?:pgm|png|jpe?g|bmp)$", re.I)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(root: str) -> list[str]:
    """Files below a folder (or that file), in order of their paths."""
    from pyarrow import fs

    system, path = _system(root)
    if system.get_file_info(path).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(root.rstrip("/") + f.path[len(path.rstrip("/")) :] for f in found if f.type == fs.FileType.File)


def opened(path: str):
    system, at = _system(path)
    return system.open_input_stream(at)


@dataclass
class Files(InputPartition):
    rows: list

    def __init__(self, rows: list):
        super().__init__(0)
        self.rows = rows


class Dealing(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.step = options["path"], int(options.get("filesPerSplit", 256))

    def dealt(self, rows: list) -> list[Files]:
        return [Files(rows[lo : lo + self.step]) for lo in range(0, len(rows), self.step)] or [Files([])]


class CaptureReader(Dealing):
    def __init__(self, options: dict, named):
        super().__init__(options)
        self.named = named
        self.only = {c: frozenset(options[c].split(",")) for c in NAMED if c in options}

    def wanted(self, row: dict) -> bool:
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return all(text(row[c]) in values for c, values in self.only.items())

    def partitions(self) -> list[Files]:
        rows = self.named(listed(self.root))
        if not rows:
            raise FileNotFoundError(f"{self.root} has no captures")
        return self.dealt([r for r in rows if self.wanted(r)])

    def read(self, partition: Files) -> Iterator[tuple]:
        for row in partition.rows:
            if row["path_2d"]:
                with opened(row["path_2d"]) as f:
                    size = images.size(f.read(HEAD))
                if size is None:
                    continue
                row = row | {"orig_w": size[0], "orig_h": size[1]}
            else:
                with opened(row["path_3d"]) as f:
                    row = row | {"n_points": Mesh(f).counts["vertex"]}
            yield tuple(row[c] for c in COLUMNS)


def _capture(dataset: str, subject: int, name: str, path: str, mesh: bool = False, **more) -> dict:
    who = f"S{subject:03d}"
    row = dict.fromkeys(COLUMNS) | {"dataset": dataset, "subject_id": who, "sample_id": f"{who}_{name}", "session": "s1", "expression": "neutral", "pose_yaw": 0.0, "pose_pitch": 0.0}
    return row | {"illumination": "normal", "occlusion": "none", "has_2d": not mesh, "has_3d": mesh, "path_3d" if mesh else "path_2d": path} | more


def single_lights(paths: list[str]) -> list[dict]:
    """Photos under single lights; those under all lights and those that name no subject are left out."""
    rows = []
    for path in paths:
        folder, _, file = path.rpartition("/")
        stem = file.rpartition(".")[0]
        who = re.search(r"(?:yaleB|subject)(\d+)", file, re.I) or re.search(r"(?:yaleB|subject)(\d+)", folder.rpartition("/")[2], re.I)
        if not _PHOTO.search(file) or "ambient" in stem.lower() or not who:
            continue
        token, pose, label, angles = stem.split("_", 1)[-1], 0, None, ""
        if light := re.search(r"_P(\d{2})A([+-]\d{3})E([+-]\d{2})", stem, re.I):
            pose, az, el = map(int, light.groups())
            label, angles = "normal" if az == el == 0 else f"yale:A{az:+04d}E{el:+03d}", f";azimuth={az};elevation={el}"
        rows.append(_capture("yaleb", int(who[1]), stem, path, pose_yaw=float(pose), illumination=label or f"yale:{token}", n_points=FACE_POINTS, notes=f"native_light={token}{angles}"))
    return rows


def meshes_with_photos(paths: list[str]) -> list[dict]:
    """Meshes, and the photos of participants who have one: of several photos with one expression the last by path."""
    meshes = {int(m[1]): p for p in paths if (m := re.search(r"/TD_3D_(\d+)\.ply$", p, re.I))}
    photos = {}
    for path in paths:
        folder, file = path.rsplit("/", 2)[-2:]
        stem = file.rpartition(".")[0]
        who = int(folder) if folder.isdigit() else int(m[1]) if (m := re.search(r"TD_RGB_E_(\d+)", stem)) else 0
        if _PHOTO.search(file) and who in meshes:
            e = int(m[1]) if (m := re.search(r"(\d+)$", stem)) else 1
            photos[who, EXPRESSIONS.get(e, f"expr_{e}")] = path
    rows = [_capture("tufts3d", n, "3d", path, True, notes="sfm_mesh") for n, path in meshes.items()]
    for (n, e), path in photos.items():
        rows.append(_capture("tufts3d", n, e, path, expression=e, occlusion="sunglasses" if e == "sunglasses" else "none", notes="rgb_e_photo"))
    return sorted(rows, key=lambda r: r["sample_id"])


class _Captures(DataSource):
    named = None

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options, type(self).named)


class YaleB(_Captures):
    named = staticmethod(single_lights)

    @classmethod
    def name(cls) -> str:
        return "yaleb"


class Tufts(_Captures):
    named = staticmethod(meshes_with_photos)

    @classmethod
    def name(cls) -> str:
        return "tufts3d"


class Mesh:
    """An ASCII mesh file, read line by line."""

    def __init__(self, stream):
        self.lines = io.TextIOWrapper(io.BufferedReader(stream, 1 << 20), "ascii", errors="replace")
        if self.lines.readline().strip() != "ply":
            raise ValueError("not a PLY file")
        self.counts, self.properties, element = {"vertex": 0, "face": 0}, [], ""
        self.elements: list[tuple[str, int]] = []
        while (line := self.lines.readline()).strip() != "end_header":
            words = line.split()
            if not line:
                raise ValueError("the header doesn't end")
            if words[:1] == ["format"] and words[1:2] != ["ascii"]:
                raise ValueError("binary PLY files aren't supported")
            if words[:1] == ["element"]:
                element = words[1]
                self.counts[element] = int(words[2])
                self.elements.append((element, int(words[2])))
            elif words[:1] == ["property"] and element == "vertex":
                self.properties.append(words[-1])

    def rows(self, element: str) -> Iterator[list[str]]:
        for name, n in self.elements:
            for _ in range(n):
                line = self.lines.readline()
                while line and not line.strip():
                    line = self.lines.readline()
                if not line:
                    raise ValueError(f"the file ends before its last {name}")
                if name == element:
                    yield line.split()


VERTICES = "path string, vertex long, px double, py double, pz double, red int, green int, blue int"
FACES = "path string, face long, a long, b long, c long"


class MeshReader(Dealing):
    def __init__(self, options: dict, element: str):
        super().__init__({"filesPerSplit": 1} | dict(options))
        self.element = element

    def partitions(self) -> list[Files]:
        return self.dealt([{"path": p} for p in listed(self.root) if p.lower().endswith(".ply")])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        take = _vertices if self.element == "vertex" else _faces
        names = [x.split()[0] for x in (VERTICES if self.element == "vertex" else FACES).split(", ")]
        for row in partition.rows:
            with opened(row["path"]) as f:
                held = []
                for r in take(Mesh(f)):
                    held.append((row["path"], *r))
                    if len(held) == BATCH:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "px": pa.float64(), "py": pa.float64(), "pz": pa.float64(), "red": pa.int32(), "green": pa.int32(), "blue": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _vertices(mesh: Mesh) -> Iterator[tuple]:
    at = {n: k for k, n in enumerate(mesh.properties)}
    if missing := [n for n in "xyz" if n not in at]:
        raise ValueError(f"vertices lack {', '.join(missing)}")
    place, colour = [at[n] for n in "xyz"], [at.get(f"diffuse_{n}", at.get(n)) for n in ("red", "green", "blue")]
    for i, r in enumerate(mesh.rows("vertex")):
        if len(r) != len(at):
            raise ValueError(f"vertex {i} is malformed")
        yield (i, *[float(r[k]) for k in place], *[None if k is None else min(255, max(0, int(float(r[k])))) for k in colour])


def _faces(mesh: Mesh) -> Iterator[tuple]:
    """Triangles, numbered; a face with more corners is a fan from its first."""
    n = 0
    for r in mesh.rows("face"):
        corners = [int(x) for x in r[1 : 1 + int(r[0])]]
        if len(corners) != int(r[0]) or not all(0 <= x < mesh.counts["vertex"] for x in corners):
            raise ValueError(f"face {n} is malformed")
        for k in range(1, len(corners) - 1):
            yield n, corners[0], corners[k], corners[k + 1]
            n += 1


class Ply(DataSource):
    """Option ``element``: vertex (default) or face. A split is a file, and a task holds one batch of it."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    @property
    def element(self) -> str:
        e = self.options.get("element", "vertex")
        if e not in ("vertex", "face"):
            raise ValueError(f"unknown element {e!r}")
        return e

    def schema(self) -> str:
        return VERTICES if self.element == "vertex" else FACES

    def reader(self, schema) -> MeshReader:
        return MeshReader(self.options, self.element)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (YaleB, Tufts, Ply):
        spark.dataSource.register(source)
