"""Marker pose estimation for every detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam

POSES = "detection_id long, image_id long, marker_id long, success boolean, T_C_M struct<R:array<array<double>>,t:array<double>>, reprojection_error_px double, error_message string"


def camera_array(camera: pd.Series, models: cam.ArrayModels) -> arrays.Lenses:
    """The cameras of a column of camera structs; a null parameter counts as 0."""
    return models.lenses([c["model"] for c in camera], [np.array([0.0 if c[n] is None else c[n] for c in camera], float) for n in arrays.CAMERA[1:]])


def estimate_marker_poses(detections: DataFrame, cameras: DataFrame, size: float) -> DataFrame:
    """A row per row of detections(detection_id, image_id, marker_id, corners, camera_id): success, T_C_M, mean corner error, error_message.

    Of the two poses of a square the one of the lower corner error is taken.
    A row that cannot be solved fails with a message and keeps its ids; no row
    fails the job.
    """
    models, unlisted = cam.ArrayModels(), set(cam.MODELS) - set(cam.ArrayModels().kinds)
    both = cam.with_camera(detections, cameras)
    model, corner = F.col("camera.model"), lambda k, n: F.get("corners", F.lit(k))[n].cast("double")
    # where the work begins each row has its corners, its model's name and its numbers, flat
    lacks = F.lit(False)
    for name, known in cam.MODELS.items():
        for n in known.required:
            lacks = F.when((model == name) & F.col(f"camera.{n}").isNull(), True).otherwise(lacks)
    rows = both.select(
        "detection_id", "image_id", "marker_id", F.coalesce(F.size("corners") == 4, F.lit(False)).alias("four"), *[corner(k, n).alias(f"{n}{k}") for k in range(4) for n in "uv"],
        model.alias("model"), lacks.alias("lacks"), *[F.coalesce(F.col(f"camera.{n}").cast("double"), F.lit(0.0)).alias(n) for n in cam.PARAMETERS],
    )
    names = list(models.kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            n = batch.num_rows
            message = np.full(n, None, object)
            whole = np.logical_and.reduce([batch.column(f"{c}{k}").is_valid().to_numpy(zero_copy_only=False) for k in range(4) for c in "uv"])
            good = column("four").astype(bool) & whole
            message[~good] = "four corners are needed"
            given = batch.column("model")
            refused = unlisted & set(given.filter(pa.array(good)).unique().to_pylist())
            if refused:
                raise ValueError(f"no array functions for camera model: {', '.join(sorted(refused))}")
            kind = pc.index_in(given, pa.array(names, given.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            lens = arrays.Lenses(np.stack([np.maximum(kind, 0).astype(float), *[column(p) for p in arrays.CAMERA[1:]]], -1), models.functions)
            pixels = np.stack([np.stack([column(f"{c}{k}") for c in "uv"], -1) for k in range(4)], 1).astype(float)
            known = good & (kind >= 0) & ~column("lacks").astype(bool)
            rays = np.full((n, 4, 3), np.nan)
            if known.any():
                with np.errstate(all="ignore"):
                    rays[known] = arrays.unproject(pixels[known], lens[known][:, None, :])
            ahead = good & (rays[..., 2] > 1e-9).all(1)
            message[good & ~ahead] = "a corner does not unproject to a forward ray"
            at = np.flatnonzero(ahead)
            R, t, errors, reason = np.zeros((n, 3, 3)), np.zeros((n, 3)), np.zeros(n), np.full(n, None, object)
            if len(at):
                R[at], t[at], errors[at], reason[at] = _solve(rays[at][..., :2] / rays[at][..., 2:], pixels[at], lens[at], size)
            message[at] = reason[at]
            done = np.zeros(n, bool)
            done[at] = [m is None for m in reason[at]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("detection_id", "image_id", "marker_id")], pa.array(done), pose_structs(R, t, done), pa.array(errors, mask=~done), pa.array(message, pa.string())],
                names=["detection_id", "image_id", "marker_id", "success", "T_C_M", "reprojection_error_px", "error_message"],
            )

    kept = rows.select(*[F.col(c).cast("long").alias(c) for c in ("detection_id", "image_id", "marker_id")], *rows.columns[3:])
    return kept.mapInArrow(run, POSES)


def pose_structs(R: np.ndarray, t: np.ndarray, there: np.ndarray) -> pa.StructArray:
    """Poses as structs of lists, null where there is none."""
    n = len(t)
    upto = lambda k, step: pa.array(np.arange(0, k * step + 1, step, dtype=np.int32))
    rows = pa.ListArray.from_arrays(upto(3 * n, 3), pa.array(R.ravel()))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(upto(n, 3), rows), pa.ListArray.from_arrays(upto(n, 3), pa.array(t.ravel()))], names=["R", "t"], mask=pa.array(~there))


def _solve(flat: np.ndarray, pixels: np.ndarray, camera: arrays.Lenses, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(R, t, mean corner error, message) of rows of corners; the message is None for a row that is solved."""
    n = len(flat)
    try:
        R, t = arrays.squares_to_poses(flat, size)
    except np.linalg.LinAlgError:
        if n > 1:  # one degenerate row must not fail its batch; halves leave the others together
            halves = [_solve(flat[k], pixels[k], camera[k], size) for k in (slice(0, n // 2), slice(n // 2, n))]
            return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        return np.zeros((1, 3, 3)), np.zeros((1, 3)), np.zeros(1), np.array(["degenerate corners"], object)
    corners = np.einsum("nsij,kj->nski", R, arrays.DETECTOR_CORNERS * size) + t[:, :, None, :]
    seen = arrays.project(corners, camera[:, None, None, :])
    error = np.linalg.norm(seen - pixels[:, None], axis=-1).mean(-1)
    front = (corners[..., 2] > 1e-9).all(-1)
    score = np.where(front & np.isfinite(error), error, np.inf)
    at = np.arange(n)
    best = score.argmin(1)
    message = np.full(n, None, object)
    lost = np.isinf(score[at, best])
    message[lost] = np.where(front.any(1), "invalid reprojection", "a corner is behind the camera")[lost]
    return R[at, best], t[at, best], score[at, best], message


def pose_summary(observations: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, mean_error_px of those that succeeded."""
    return observations.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.avg(F.when(F.col("success"), F.col("reprojection_error_px"))).alias("mean_error_px"))
