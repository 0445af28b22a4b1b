"""Points in space: radius join, duplicate merge, refinement, samples, bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam
from vertexmill.functions.losses import loss
from vertexmill.operators.greedy import greedy_groups
from vertexmill.operators.poses import camera_array
from vertexmill.plans.checkpoints import cut, written

#: Observations that a task of the refinement holds, about.
BUCKET_ROWS = 50_000


#: The cells that a cell's points meet: itself and one of each two that lie opposite.
_HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(i, j, distance), i < j, of points(point_id, x, y, z) within the radius, by a grid of that width; none for a radius of 0 or less.

    Neither side is broadcast: the copies in the cells around are many times the
    points' files.
    """
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"] if radius > 0 else [F.lit(0).cast("long").alias(f"c{c}") for c in "xyz"]
    own = points.filter(F.lit(radius > 0)).select("point_id", "x", "y", "z", *cell)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in _HALF])
    a = own.select("cx", "cy", "cz", F.col("point_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    b = own.withColumn("s", F.explode(shifts)).select((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), (F.col("cz") + F.col("s.k")).alias("cz"), F.col("point_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"), ((F.col("s.i") == 0) & (F.col("s.j") == 0) & (F.col("s.k") == 0)).alias("home"))
    square = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")) + (F.col("za") - F.col("zb")) * (F.col("za") - F.col("zb"))
    met = a.join(b.hint("merge"), ["cx", "cy", "cz"]).filter("not home or a < b").withColumn("distance", F.sqrt(square)).filter((F.col("distance") <= radius) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "distance")


def merge_groups(points: DataFrame, observations: DataFrame, radius: float = 0.02, max_mean_px: float = 3.0, max_px: float = 6.0) -> DataFrame:
    """(point_id, root) of all points: near points joined in (i, j) order unless an error is over its limit or an image repeats.

    points(point_id, track_id, x, y, z, mean_reprojection_error_px,
    max_reprojection_error_px), observations(track_id, image_id). Null errors
    pass; a point without track has no images.
    """
    fine = (F.coalesce("mean_reprojection_error_px", F.lit(0.0)) <= max_mean_px) & (F.coalesce("max_reprojection_error_px", F.lit(0.0)) <= max_px)
    seen = points.filter("track_id is not null").select("point_id", "track_id").join(observations.select("track_id", "image_id"), "track_id")
    repeats = seen.groupBy("point_id", "image_id").agg(F.count("*").alias("n")).filter("n > 1").select("point_id").distinct()
    open_ = points.filter(fine).join(repeats, "point_id", "left_anti").select("point_id")
    pairs = radius_pairs(points, radius).join(open_.withColumnRenamed("point_id", "i"), "i", "left_semi").join(open_.withColumnRenamed("point_id", "j"), "j", "left_semi")
    groups = greedy_groups(pairs.select(F.col("i").alias("u"), F.col("j").alias("v"), F.struct("i", "j").alias("place")), seen.select(F.col("point_id").alias("node"), F.col("image_id").alias("image")))
    return points.select("point_id").join(groups.select(F.col("node").alias("point_id"), "root"), "point_id", "left").withColumn("root", F.coalesce("root", "point_id"))


def merge_points(points: DataFrame, groups: DataFrame) -> DataFrame:
    """One point a group: the centre weighted by observations, the mean error weighted likewise over the errors known, the largest error, the sum of observations, the first point's track."""
    weight = F.greatest(F.coalesce("num_observations", F.lit(1)).cast("double"), F.lit(1.0))
    error = F.col("mean_reprojection_error_px")
    known = F.when(error.isNotNull(), F.col("w"))
    rows = points.join(groups, "point_id").withColumn("w", weight)
    n = F.coalesce(F.sum("num_observations"), F.lit(0))
    return rows.groupBy("root").agg(
        F.min_by("track_id", "point_id").alias("track_id"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "xyz"],
        (F.sum(error * F.col("w")) / F.sum(known)).alias("mean_reprojection_error_px"), F.max(F.coalesce("max_reprojection_error_px", F.lit(0.0))).alias("max_reprojection_error_px"),
        F.when(n > 0, n).alias("num_observations"), F.when(F.count("*") > 1, "merged").otherwise(F.min_by("source", "point_id")).alias("source"), F.lit(True).alias("is_active"), F.count("*").alias("num_points"),
    ).withColumnRenamed("root", "point_id")


def point_observations(points: DataFrame, observations: DataFrame, poses: DataFrame) -> DataFrame:
    """Active points with their track's observations and the poses of their images; observations without a pose go. Poses are not broadcast, whatever their files' size."""
    o = observations.select("track_id", "image_id", F.col("x").alias("u"), F.col("y").alias("v"))
    return points.filter("is_active").select("point_id", "track_id", "x", "y", "z").join(o, "track_id").join(poses.select("image_id", "T", "camera_id").hint("merge"), "image_id")


def refine_points(points: DataFrame, observations: DataFrame, poses: DataFrame, cameras: DataFrame, mode: str = "points_only", loss_name: str = "huber", scale: float = 3.0, iterations: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(point_id, x, y, z, initial_cost, final_cost, mean_error_px) of points moved to the least robust reprojection error, cameras fixed.

    Each point is a problem of its own. Points are dealt into buckets with all
    their observations (an image each) and a bucket is solved at once by damped
    Gauss-Newton steps. points_and_cameras keeps cameras fixed as well.
    """
    if mode not in ("points_only", "points_and_cameras"):
        raise ValueError(f"mode {mode} is not supported")
    loss(loss_name)
    models = cam.ArrayModels()
    rows = written(cam.with_camera(point_observations(points, observations, poses), cameras))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("point_id"), F.lit(buckets))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(frame["point_id"].to_numpy(), return_inverse=True)
        first = np.unique(at, return_index=True)[1]
        X = frame[["x", "y", "z"]].to_numpy()[first]
        R = np.array([[list(r) for r in T["R"]] for T in frame["T"]])
        C = np.array([list(T["t"]) for T in frame["T"]])
        X, start, end, error = _refine(X, at, R, C, camera_array(frame["camera"], models), frame[["u", "v"]].to_numpy(float), loss_name, scale, iterations, tolerance)
        return pd.DataFrame({"point_id": ids, "x": X[:, 0], "y": X[:, 1], "z": X[:, 2], "initial_cost": start, "final_cost": end, "mean_error_px": error})

    schema = "point_id long, x double, y double, z double, initial_cost double, final_cost double, mean_error_px double"
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda f: run(f), schema)


PENALTY = 1e6


def _refine(X, at, R, C, camera, pixels, loss_name, scale, iterations, tolerance):
    rho = loss(loss_name)

    def residuals(X):
        p = np.einsum("nji,nj->ni", R, X[at] - C)
        seen = arrays.project(p, camera)
        bad = (p[:, 2] <= 1e-12) | ~np.isfinite(seen).all(1)
        return np.where(bad[:, None], PENALTY, pixels - seen)

    def costs(r):
        return np.bincount(at, 0.5 * rho.rho((r * r).sum(1), scale), len(X))

    r = residuals(X)
    start = cost = costs(r)
    damping = np.full(len(X), 1e-4)
    active = np.ones(len(X), bool)
    for _ in range(iterations):
        p = np.einsum("nji,nj->ni", R, X[at] - C)
        seen, slopes = arrays.project_slopes(p, camera)
        bad = (p[:, 2] <= 1e-12) | ~np.isfinite(seen).all(1)
        J = -np.where(bad[:, None, None], 0.0, slopes) @ np.swapaxes(R, 1, 2)
        w = rho.weight((r * r).sum(1), scale)
        A = np.zeros((len(X), 3, 3))
        b = np.zeros((len(X), 3))
        np.add.at(A, at, w[:, None, None] * np.einsum("nki,nkj->nij", J, J))
        np.add.at(b, at, w[:, None] * np.einsum("nki,nk->ni", J, r))
        diagonal = np.einsum("nii->ni", A)
        step = -np.linalg.solve(A + np.eye(3) * (damping[:, None] * diagonal + 1e-12)[:, None, :], b[..., None])[..., 0]
        step[~active] = 0
        trial = X + step
        r_new = residuals(trial)
        new = costs(r_new)
        better = active & (new < cost)
        X = np.where(better[:, None], trial, X)
        settled = better & (cost - new <= tolerance * np.maximum(cost, 1e-300))
        damping = np.where(better, np.maximum(damping / 10, 1e-12), damping * 10)
        cost = np.where(better, new, cost)
        r = np.where(better[at][:, None], r_new, r)
        active &= ~settled & (damping < 1e10)
        if not active.any():
            break
    counts = np.maximum(np.bincount(at, minlength=len(X)), 1)
    return X, start, cost, np.bincount(at, np.linalg.norm(r, axis=1), len(X)) / counts


def stride_sample(rows: DataFrame, most: int, order: str) -> DataFrame:
    """At most `most` rows at even strides in the given order, the first and the last among them; all rows if there are not more.

    Rows are numbered from the counts of range partitions, so that none has to
    be ordered in one task.
    """
    if most <= 0:
        return rows.limit(0)
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("stride_part", F.spark_partition_id()).withColumn("stride_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = cut(parts)
    sizes = parts.groupBy("stride_part").agg(F.count("*").alias("n"))
    # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("stride_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    offsets = sizes.select("stride_part", before.alias("stride_before"), total.alias("stride_total"))
    numbered = parts.join(F.broadcast(offsets), "stride_part").withColumn("stride_at", F.col("stride_before") + F.col("stride_row"))
    # row i is the k-th pick if floor(k (n - 1) / (most - 1)) is i for some k
    at, n = F.col("stride_at"), F.col("stride_total")
    k = F.ceil(at * (most - 1) / (n - 1)).cast("long") if most > 1 else F.lit(0).cast("long")
    hit = F.floor(k * (n - 1) / F.lit(most - 1)) == at if most > 1 else at == 0
    return numbered.filter((n <= most) | (n < 2) | hit).select(*rows.columns)


def bounds(points: DataFrame, least: float = 0.1) -> DataFrame:
    """One row: the centre (x, y, z) of the box of points and radius, half its longest side, `least` or more."""
    b = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    side = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"])
    return b.select(*[((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(c) for c in "xyz"], F.greatest(side / 2, F.lit(least)).alias("radius"))
