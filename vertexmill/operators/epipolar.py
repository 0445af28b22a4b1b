"""Epipolar filter of matches by known camera poses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam
from vertexmill.functions import matches as mt
from vertexmill.plans.checkpoints import written

#: Error types: name to (errors of two rays of any length, rotation and translation). Any other name means ray_angular.
ERRORS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {"ray_angular": mt.ray_angular_error, "sampson": mt.sampson_error}
LIMITS = {"ray_angular": 0.003, "sampson": 1e-4}
#: Up to so many images every task has the poses, 200 bytes each; those of more are shuffled to their matches.
LOOKED_UP = 20_000


def match_geometry(matches: DataFrame, poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """matches(image_id_a, image_id_b, x_a, y_a, x_b, y_b, ...) with T_a, T_b, camera, ray_a and ray_b, which are not brought to length one; matches without both poses are left out.

    poses(image_id, T, camera_id). The small tables are broadcast by the
    optimizer as their size allows; matches are not grouped.
    """
    side = lambda n: poses.select(F.col("image_id").alias(f"image_id_{n}"), F.col("T").alias(f"T_{n}"), *([F.col("camera_id")] if n == "a" else []))
    both = cam.with_camera(matches.join(side("a"), "image_id_a").join(side("b"), "image_id_b"), cameras)

    models = cam.ArrayModels()

    def rays(batch) -> dict[str, np.ndarray]:
        camera = mt.cameras(batch.column("camera"), models)
        return {f"ray_{n}": arrays.rays(np.stack([mt.numbers(batch.column(f"x_{n}")), mt.numbers(batch.column(f"y_{n}"))], -1), camera) for n in "ab"}

    return mt.with_columns(both, "ray_a array<double>, ray_b array<double>", rays)


def _rays(batch, n: str) -> np.ndarray:
    return batch.column(f"ray_{n}").flatten().to_numpy().reshape(-1, 3)


def with_epipolar_error(located: DataFrame, error_type: str = "ray_angular", limit: float | None = None, min_baseline: float = 0.03) -> DataFrame:
    """located, from match_geometry(), with epipolar_error and is_epipolar_inlier; pairs that stand closer than min_baseline have infinite error."""
    name = error_type if error_type in ERRORS else "ray_angular"
    bound = LIMITS.get(name, 0.0) if limit is None else limit

    def errors(batch) -> dict[str, np.ndarray]:
        (Ra, ta), (Rb, tb) = (mt.poses(batch.column(f"T_{n}")) for n in "ab")
        (error,) = _errors({n: _rays(batch, n) for n in "ab"}, Ra, ta, Rb, tb, (name,), min_baseline)
        return {"epipolar_error": error, "is_epipolar_inlier": error <= bound}

    return mt.with_columns(located, "epipolar_error double, is_epipolar_inlier boolean", errors)


def match_errors(matches: DataFrame, poses: DataFrame, cameras: DataFrame, kept: tuple[str, ...] = ("match_id",), error_types: tuple[str, ...] = ("ray_angular",), limits: dict[str, float] | None = None, min_baseline: float = 0.03) -> DataFrame:
    """(kept columns, error_type, epipolar_error, is_epipolar_inlier) of matches by one or more error types, as with_epipolar_error(match_geometry()) gives them.

    Rays and relative poses are made once for all types, and no ray leaves its
    task. The images that occur are listed first. Where they are few, tasks look
    up their poses and cameras in arrays; else these are shuffled to the matches.
    """
    models, names = cam.ArrayModels(), list(arrays.CAMERA[1:])
    bounds = LIMITS | (limits or {})
    used = written(matches.select(F.explode(F.array("image_id_a", "image_id_b")).alias("image_id")).distinct())
    kind = F.lit(-1.0)
    for name, k in models.kinds.items():
        kind = F.when(F.col("camera.model") == name, float(k)).otherwise(kind)
    pose = [F.col("T.R")[i][j].alias(f"R{i}{j}") for i in range(3) for j in range(3)] + [F.col("T.t")[i].alias(f"t{i}") for i in range(3)]
    flat, lens = [f"R{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"], ["kind", *names]
    # a pose without camera is that of an image b only
    numbers = [F.col("image_id"), *[F.col(n) for n in flat], kind.alias("kind"), *[F.col(f"camera.{n}").cast("double").alias(n) for n in names]]
    packed = cameras.select("camera_id", F.struct(*cameras.columns).alias("camera"))
    seen = poses.join(used, "image_id", "left_semi").select("image_id", "camera_id", *pose).join(packed, "camera_id", "left").select(F.col("camera").isNotNull().alias("has_camera"), *numbers)
    found = seen.toArrow() if used.count() <= LOOKED_UP else None
    if found is not None and len(found.column("image_id").unique()) < len(found):
        found = None
    rows = matches.select(*kept, "image_id_a", "image_id_b", *[F.col(c).cast("double").alias(f"__{c}") for c in ("x_a", "y_a", "x_b", "y_b")])
    if found is None:
        side = lambda df, c: df.select(F.col("image_id").alias(f"image_id_{c}"), *[F.col(n).alias(f"__{n}_{c}") for n in (*flat, *(lens if c == "a" else []))]).hint("merge")
        rows = rows.join(side(seen.filter("has_camera"), "a"), "image_id_a").join(side(seen, "b"), "image_id_b")
        table = ids = has = None
    else:
        found = found.sort_by("image_id")
        ids, has = found.column("image_id").to_numpy(), found.column("has_camera").to_numpy()
        table = np.stack([mt.numbers(found.column(n)) for n in (*flat, *lens)], -1)
    schema = T.StructType([rows.schema[c] for c in kept] + [f for k in range(len(error_types)) for f in (T.StructField(f"error_{k}", T.DoubleType()), T.StructField(f"good_{k}", T.BooleanType()))])

    def placed(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The matches of a batch with both poses, and their rows of numbers."""
        if table is None:
            return batch, *[np.stack([mt.numbers(batch.column(f"__{n}_{c}")) for n in (*flat, *(lens if c == "a" else []))], -1) for c in "ab"]
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("image_id_a")), pc.is_valid(batch.column("image_id_b"))))
        image = [batch.column(f"image_id_{c}").to_numpy() for c in "ab"]
        at = [np.minimum(np.searchsorted(ids, i), max(len(ids) - 1, 0)) for i in image]
        good = (ids[at[0]] == image[0]) & (ids[at[1]] == image[1]) & has[at[0]] if len(ids) else np.zeros(len(batch), bool)
        return batch.filter(pa.array(good)), *[table[i[good]] if len(ids) else table for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch, a, b = placed(whole)
            if (a[:, 12] < 0).any():
                raise ValueError("no array functions for a camera model")
            lenses = arrays.Lenses(np.concatenate([a[:, 12:13], np.nan_to_num(a[:, 13:])], 1), models.functions)
            ray = {c: arrays.rays(np.stack([mt.numbers(batch.column(f"__x_{c}")), mt.numbers(batch.column(f"__y_{c}"))], -1), lenses) for c in "ab"}
            made = []
            for name, error in zip(error_types, _errors(ray, a[:, :9].reshape(-1, 3, 3), a[:, 9:12], b[:, :9].reshape(-1, 3, 3), b[:, 9:12], error_types, min_baseline), strict=True):
                made += [pa.array(error), pa.array(error <= bounds.get(name if name in ERRORS else "ray_angular", 0.0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=schema.names)

    each = F.explode(F.array(*[F.struct(F.lit(name).alias("error_type"), F.col(f"error_{k}").alias("epipolar_error"), F.col(f"good_{k}").alias("is_epipolar_inlier")) for k, name in enumerate(error_types)]))
    return rows.mapInArrow(run, schema).select(*kept, each.alias("e")).select(*kept, "e.*")


def _errors(ray: dict[str, np.ndarray], Ra: np.ndarray, ta: np.ndarray, Rb: np.ndarray, tb: np.ndarray, kinds: tuple[str, ...], min_baseline: float) -> list[np.ndarray]:
    """The errors of each kind of rays a and b by their poses; infinite for pairs that stand closer than min_baseline."""
    R, t = np.stack([mt.turned_back(Rb, Ra[:, :, k]) for k in range(3)], -1), mt.turned_back(Rb, ta - tb)
    close = mt.length(ta - tb) < min_baseline
    return [np.where(close, np.inf, ERRORS.get(kind, mt.ray_angular_error)(ray["a"], ray["b"], R, t)) for kind in kinds]


def triangulate_pairs(located: DataFrame, min_angle_deg: float = 1.0, max_px: float = 6.0, max_gap: float = 0.25, max_depth: float = 100.0) -> DataFrame:
    """located, from match_geometry(), with the midpoint (x, y, z), gap_m, angle_deg, error_a_px, error_b_px and is_valid of each match."""
    models = cam.ArrayModels()

    def points(batch) -> dict[str, np.ndarray]:
        camera = mt.cameras(batch.column("camera"), models)
        T = {n: mt.poses(batch.column(f"T_{n}")) for n in "ab"}
        d = {n: mt.turned(T[n][0], mt.unit(_rays(batch, n))) for n in "ab"}
        c, dot = {n: T[n][1] for n in "ab"}, mt.dot
        k, wa, wb = dot(d["a"], d["b"]), dot(c["b"] - c["a"], d["a"]), dot(c["b"] - c["a"], d["b"])
        scale = 1 - k * k
        safe = np.where(np.abs(scale) > mt.EPSILON, scale, mt.EPSILON)
        pa, pb = c["a"] + d["a"] * ((wa - k * wb) / safe)[:, None], c["b"] + d["b"] * ((k * wa - wb) / safe)[:, None]
        p = (pa + pb) / 2
        gap, angle = mt.length(pa - pb), np.degrees(np.arccos(np.clip(k, -1.0, 1.0)))
        error = {n: _pixel_error(p, *T[n], camera, batch.column(f"x_{n}"), batch.column(f"y_{n}")) for n in "ab"}
        far = np.maximum(mt.length(p - c["a"]), mt.length(p - c["b"]))
        valid = (dot(p - c["a"], d["a"]) > 0) & (dot(p - c["b"], d["b"]) > 0) & (angle >= min_angle_deg) & (error["a"] <= max_px) & (error["b"] <= max_px) & (gap <= max_gap) & (far <= max_depth)
        return {"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "gap_m": gap, "angle_deg": angle, "error_a_px": error["a"], "error_b_px": error["b"], "is_valid": valid}

    schema = "x double, y double, z double, gap_m double, angle_deg double, error_a_px double, error_b_px double, is_valid boolean"
    return mt.with_columns(located, schema, points, drop=("ray_a", "ray_b", "T_a", "T_b", "camera"))


def _pixel_error(p: np.ndarray, R: np.ndarray, t: np.ndarray, camera: arrays.Lenses, x, y) -> np.ndarray:
    """Distances in the image of points p from the pixels (x, y); NaN where a point is not seen."""
    seen = arrays.project(mt.turned_back(R, p - t), camera)
    return np.hypot(seen[:, 0] - mt.numbers(x), seen[:, 1] - mt.numbers(y))


def pair_results(filtered: DataFrame, min_inliers: int = 8) -> DataFrame:
    """(image_id_a, image_id_b, num_epipolar_inliers, status) of the pairs in filtered: filtered, or few_inliers."""
    counts = filtered.groupBy("image_id_a", "image_id_b").agg(F.count_if("is_epipolar_inlier").alias("num_epipolar_inliers"))
    return counts.withColumn("status", F.when(F.col("num_epipolar_inliers") >= min_inliers, "filtered").otherwise("few_inliers"))


def update_pairs(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """pairs with the results' status and inliers; pairs without a result stay as they are."""
    new = results.select("image_id_a", "image_id_b", F.col("num_epipolar_inliers").alias("new_inliers"), F.col("status").alias("new_status"))
    both = pairs.join(new, ["image_id_a", "image_id_b"], "left")
    return both.withColumns({"status": F.coalesce("new_status", "status"), "num_epipolar_inliers": F.coalesce("new_inliers", "num_epipolar_inliers")}).select(*pairs.columns)
