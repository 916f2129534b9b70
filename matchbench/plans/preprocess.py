"""From photos, depth maps and meshes to arrays of one size, with a table as cache.

Arrays are rows (sample_id, kind, cfg_hash, digest, ok, detail, data, made): ``image`` (brightness), ``depth``
(normalised range) and ``landmarks`` (five marks in space). A row is fresh while its settings' hash and
its file's digest are the capture's; only captures without fresh rows are read and computed again.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import manifest as M
from ..sources import files as sources
from ..sources import images, toy

#: Five marks on a square of 112 pixels that photos are aligned to, fixed values.
TEMPLATE_112 = ((30.2946, 51.6963), (81.7054, 51.6963), (56.0, 71.5), (38.0, 88.0), (74.0, 88.0))
SCHEMA = "sample_id string, kind string, cfg_hash string, digest string, ok boolean, detail string, data array<double>, made timestamp"


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def detect(image: np.ndarray, landmarks: np.ndarray | None, method: str = "landmarks") -> tuple[np.ndarray | None, str]:
    """The five marks and where they are from: given ones (``ground_truth``), or, for photos that are
    cropped already, fixed places of the whole photo. Networks and cascades aren't shipped."""
    from ..operators.fields import BOX_LANDMARKS

    if landmarks is not None and np.shape(landmarks) == (5, 2) and np.isfinite(landmarks).all():
        return np.asarray(landmarks, np.float64), "ground_truth"
    if method == "whole":
        return np.array(BOX_LANDMARKS) * np.array(image.shape[1::-1]), "whole"
    return None, "none"


def shrink(a: np.ndarray, size: int) -> np.ndarray:
    """Area means on a size x size grid."""
    for _ in (0, 1):
        n = a.shape[0]
        edge = np.linspace(0, n, size + 1)
        cover = np.clip(np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n)), 0, None)
        a = (cover / cover.sum(1, keepdims=True) @ a).T
    return a


def photo(content: bytes, landmarks: np.ndarray | None, settings: dict) -> tuple[np.ndarray, bool, str]:
    """Aligned brightness, whether a face was found, and how."""
    size, crop = settings["align"]["size_112"], settings["align"]["size_64"]
    image = images.decode(content)
    found, how = detect(image, landmarks, settings["detector"]["method"])
    if found is None:
        return np.zeros((crop, crop)), False, how
    template = np.array(settings["align"].get("template", TEMPLATE_112)) * (size / 112)
    a = shrink(K.warp(images.gray(image), *K.similarity(found, template), size), crop)
    return K.normalise_light(a, settings["illum"]["method"], **settings["illum"].get("params", {})), True, how


def depth_map(path: str, content: bytes, settings: dict) -> np.ndarray:
    if path.lower().endswith(".ply"):
        return K.cloud_to_depth(sources.parse_ply(content)[0], settings["range"]["size"])
    return np.load(io.BytesIO(content)).astype(np.float64)


def landmark_quality(points: np.ndarray, count: int = 5, nose: int = 2) -> dict:
    """Flags of a set of marks in space: right shape and finite; and the same for the tip of the nose alone."""
    p = np.asarray(points, np.float64)
    shaped = p.ndim == 2 and p.shape[1] == 3
    return {"n_points": len(p), "detect_ok": bool(shaped and len(p) == count and np.isfinite(p).all()), "nosetip_ok": bool(shaped and len(p) > nose and np.isfinite(p[nose]).all())}


def nose_tip(points: np.ndarray, nose: int = 2) -> np.ndarray:
    if not landmark_quality(points, len(points), nose)["nosetip_ok"]:
        raise ValueError("the tip of the nose is missing or not finite")
    return np.asarray(points, np.float64)[nose]


def stale(manifest: DataFrame, contents: DataFrame, cache: DataFrame | None, settings: dict) -> DataFrame:
    """Rows (sample_id, kind, path, content, digest, cfg_hash, marks) to compute: one for each photo, depth map
    or mesh whose settings or bytes aren't in the cache."""
    x = manifest.select("sample_id", "path_landmarks", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(p).alias("path"), F.lit(settings_hash(settings[s])).alias("cfg_hash")) for k, p, s in (("image", "path_2d", "2d"), ("depth", "path_3d", "3d"))])).alias("v"))
    x = x.select("sample_id", "path_landmarks", "v.*").where("path is not null")
    bare = lambda c: F.regexp_replace(c, r"^file:(//)?", "")
    c = contents.select(bare("path").alias("p"), "content")
    x = x.join(c, bare(F.col("path")) == F.col("p")).drop("p").withColumn("digest", F.sha2("content", 256))
    if cache is not None:
        x = M.stale(x, cache.select("sample_id", "kind", "cfg_hash", "digest"), ["sample_id", "kind", "cfg_hash", "digest"])
    lmk = contents.where("path like '%.json'").select(bare("path").alias("l"), F.from_json(F.col("content").cast("string"), "landmarks_5 array<array<double>>")["landmarks_5"].alias("marks"))
    return x.join(lmk, bare(F.col("path_landmarks")) == F.col("l"), "left").select("sample_id", "kind", "path", "content", "digest", "cfg_hash", "marks")


def compute(rows: DataFrame, settings: dict) -> DataFrame:
    """Arrays of the rows that ``stale`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                marks = np.array(r["marks"], np.float64) if r["marks"] else None
                base = {k: r[k] for k in ("sample_id", "cfg_hash", "digest")}
                if r["kind"] == "image":
                    a, ok, how = photo(r["content"], marks, settings["2d"])
                    out.append(base | {"kind": "image", "ok": ok, "detail": how, "data": a.ravel().tolist()})
                    continue
                depth = depth_map(r["path"], r["content"], settings["3d"])
                a, holes = K.range_image(depth, settings["3d"]["range"]["size"], settings["3d"]["range"]["z_norm"])
                out.append(base | {"kind": "depth", "ok": bool(holes < 0.9), "detail": f"{holes:.6f}", "data": a.ravel().tolist()})
                if marks is not None and marks.shape == (5, 2):
                    points = toy.spatial(marks, depth)
                    out.append(base | {"kind": "landmarks", "ok": landmark_quality(points)["nosetip_ok"], "detail": "", "data": points.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows.mapInArrow(run, SCHEMA.replace(", made timestamp", "")).withColumn("made", F.current_timestamp())


_ARROW = pa.schema([(n, pa.string()) for n in ("sample_id", "kind", "cfg_hash", "digest")] + [("ok", pa.bool_()), ("detail", pa.string()), ("data", pa.list_(pa.float64()))])


def latest(arrays: DataFrame, settings: dict, contents: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """The arrays that were computed with these settings, one for each capture and kind: those of the files as they are
    now, by ``contents`` (path, content) and the manifest's paths; without these, the newest rows (``made``)."""
    of = F.when(F.col("kind") == "image", settings_hash(settings["2d"])).otherwise(settings_hash(settings["3d"]))
    x = arrays.where(F.col("cfg_hash") == of)
    if contents is not None:
        bare = lambda c: F.regexp_replace(c, r"^file:(//)?", "")
        now = contents.select(bare("path").alias("p"), F.sha2("content", 256).alias("digest"))
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(p).alias("path")) for k, p in (("image", "path_2d"), ("depth", "path_3d"), ("landmarks", "path_3d"))])
        wanted = manifest.select("sample_id", F.explode(kinds).alias("v")).select("sample_id", "v.*").where("path is not null")
        wanted = wanted.join(now, bare(F.col("path")) == F.col("p")).select("sample_id", "kind", "digest")
        x = x.join(wanted, ["sample_id", "kind", "digest"], "left_semi")
    w = Window.partitionBy("sample_id", "kind").orderBy(F.col("made").desc_nulls_last(), F.col("digest"))
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flagged(manifest: DataFrame, arrays: DataFrame, modality: str = "both") -> DataFrame:
    """The manifest with stage and quality flags from the arrays."""
    ok = arrays.groupBy("sample_id").agg(F.max(F.when(F.col("kind") == "image", F.col("ok"))).alias("_i"), F.max(F.when(F.col("kind") == "depth", F.col("ok"))).alias("_d"))
    m = manifest.drop("detect_ok", "align_ok", "nosetip_ok", "quality_flag").join(ok, "sample_id", "left")
    f = lambda c: F.coalesce(c, F.lit(False))
    m = m.withColumns({"detect_ok": f("_i"), "align_ok": f("_i"), "nosetip_ok": f("_d")}).withColumn("quality_flag", M.quality_flag(modality))
    return m.select(manifest.columns)


def absent(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows (sample_id, kind, path) of the manifest whose file isn't there: what preprocessing passes over."""
    bare = lambda c: F.regexp_replace(c, r"^file:(//)?", "")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(p).alias("path")) for k, p in (("image", "path_2d"), ("depth", "path_3d"), ("landmarks", "path_landmarks"))])
    x = manifest.select("sample_id", F.explode(kinds).alias("v")).select("sample_id", "v.*").where("path is not null")
    return x.join(contents.select(bare("path").alias("p")), bare(F.col("path")) == F.col("p"), "left_anti")


def captures(manifest: DataFrame, arrays: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The manifest's rows with a column for each kind of array. A capture that has the source of a kind but
    not its array is an error; so is a mix of real and synthetic captures."""
    modalities = sorted(r[0] for r in manifest.select("data_modality").distinct().collect())
    if len(modalities) > 1:
        raise ValueError(f"an experiment can't mix {modalities}")
    source = {"image": "has_2d", "depth": "has_3d", "landmarks": "has_3d"}
    out = manifest
    for k in kinds:
        one = arrays.where(F.col("kind") == k).select("sample_id", F.col("data").alias(k))
        if n := manifest.where(source[k]).join(one, "sample_id", "left_anti").count():
            raise ValueError(f"{n} captures have no {k} array; preprocess them first")
        out = out.join(one, "sample_id")
    return out
