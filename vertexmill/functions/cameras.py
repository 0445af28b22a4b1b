"""Camera models as column builders, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from . import geometry as g

STEPS = 10
NAN = float("nan")
PARAMETERS = ("fx", "fy", "cx", "cy", "xi", "k1", "k2", "p1", "p2", "k3")


def distort(x: Column, y: Column, c) -> tuple[Column, Column]:
    """Radial and tangential distortion of normalised image points. c: parameter name to column."""
    r2 = x * x + y * y
    radial = 1 + r2 * (c("k1") + r2 * (c("k2") + r2 * c("k3")))
    return x * radial + 2 * c("p1") * x * y + c("p2") * (r2 + 2 * x * x), y * radial + c("p1") * (r2 + 2 * y * y) + 2 * c("p2") * x * y


def undistort(x: Column, y: Column, c) -> Column:
    """struct(x, y) that distorts to (x, y): STEPS steps of a fixed-point iteration."""
    def step(s, _):
        dx, dy = distort(s["x"], s["y"], c)
        return F.struct((s["x"] + x - dx).alias("x"), (s["y"] + y - dy).alias("y"))

    return F.aggregate(F.array_repeat(F.lit(0), STEPS), F.struct(x.alias("x"), y.alias("y")), step)


class Model(NamedTuple):
    """project(point, parameters) to struct(u, v), NaN where it is not seen; unproject(struct(u, v), parameters) to a unit vector; required: names of parameters that must be there.

    The solvers that work on arrays (poses, adjustment, epipolar errors,
    triangulation, refinement) take the last two: project_array(points (n, 3),
    {parameter: (n,)}) to (n, 2) and unproject_array(pixels (n, 2), ...) to
    (n, 3). Those jobs fail on a camera whose model has none.
    """

    project: Callable[[Column, Callable[[str], Column]], Column]
    unproject: Callable[[Column, Callable[[str], Column]], Column]
    required: tuple[str, ...]
    project_array: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray] | None = None
    unproject_array: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray] | None = None


def _pixel(x: Column, y: Column, seen: Column, c) -> Column:
    xd, yd = distort(x, y, c)
    return F.struct(F.when(seen, c("fx") * xd + c("cx")).otherwise(NAN).alias("u"), F.when(seen, c("fy") * yd + c("cy")).otherwise(NAN).alias("v"))


def _project_pinhole(p: Column, c) -> Column:
    seen = p[2] > g.EPSILON
    z = F.when(seen, p[2]).otherwise(1.0)
    return _pixel(p[0] / z, p[1] / z, seen, c)


def _project_omni(p: Column, c) -> Column:
    n = g.norm(p)
    depth = p[2] + c("xi") * n
    seen = (n > g.EPSILON) & (depth > g.EPSILON * n)
    z = F.when(seen, depth).otherwise(1.0)
    return _pixel(p[0] / z, p[1] / z, seen, c)


def _flat(pixel: Column, c) -> Column:
    return undistort((pixel["u"] - c("cx")) / c("fx"), (pixel["v"] - c("cy")) / c("fy"), c)


def _once(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _unproject_pinhole(pixel: Column, c) -> Column:
    return _once(_flat(pixel, c), lambda s: g.unit(g.vector(s["x"], s["y"], 1)))


def _unproject_omni(pixel: Column, c) -> Column:
    def ray(s):
        r2 = s["x"] * s["x"] + s["y"] * s["y"]
        alpha = (c("xi") + F.sqrt(F.greatest(F.lit(0.0), 1 + (1 - c("xi") * c("xi")) * r2))) / (1 + r2)
        return g.unit(g.vector(alpha * s["x"], alpha * s["y"], alpha - c("xi")))

    return _once(_flat(pixel, c), ray)


MODELS = {
    "pinhole_radtan": Model(_project_pinhole, _unproject_pinhole, ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")),
    "omni_radtan": Model(_project_omni, _unproject_omni, ("xi", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")),
}


BUILT_IN = tuple(MODELS)


def register(name: str, model: Model) -> None:
    """Add a camera model; project and unproject then know cameras of this name."""
    MODELS[name] = model


class ArrayModels:
    """The models as they are registered now, for tasks, which do not see later registrations or the driver's."""

    def __init__(self):
        own = [(n, m) for n, m in MODELS.items() if n not in BUILT_IN and m.project_array and m.unproject_array]
        self.kinds = {n: k for k, n in enumerate((*BUILT_IN, *[n for n, _ in own]))}
        self.functions = tuple((m.project_array, m.unproject_array) for _, m in own)

    def lenses(self, names: Iterable[str | None], parameters: list[np.ndarray]) -> arrays.Lenses:
        """Cameras of arrays from model names and the parameters of arrays.CAMERA; a model without array functions is an error."""
        names = list(names)
        missing = {n for n in names if n not in self.kinds}
        if missing:
            raise ValueError(f"no array functions for camera model: {', '.join(sorted(map(str, missing)))}")
        return arrays.Lenses(np.stack([np.array([self.kinds[n] for n in names], float), *parameters], -1), self.functions)


def _by_model(name: Column, build) -> Column:
    out = F.lit(None)
    for known, model in MODELS.items():
        out = F.when(name == known, build(model)).otherwise(out)
    return out


def project_column(point: Column, camera: Column) -> Column:
    """struct(u, v) of a point in the camera's frame; camera: a struct of the cameras table. Null for an unknown model."""
    return _by_model(camera["model"], lambda m: m.project(point, lambda n: camera[n]))


def unproject_column(pixel: Column, camera: Column) -> Column:
    """Unit ray of struct(u, v)."""
    return _by_model(camera["model"], lambda m: m.unproject(pixel, lambda n: camera[n]))


def with_camera(df: DataFrame, cameras: DataFrame) -> DataFrame:
    """df(camera_id, ...) with its camera as struct column "camera". There is one row a camera; the optimizer broadcasts the table if it is small."""
    packed = cameras.select("camera_id", F.struct(*cameras.columns).alias("camera"))
    return df.join(packed, "camera_id")


def project(df: DataFrame, cameras: DataFrame, point: str = "point") -> DataFrame:
    """df(camera_id, point) with column pixel; NaN where a point is not seen."""
    return with_camera(df, cameras).withColumn("pixel", project_column(F.col(point), F.col("camera"))).drop("camera")


def unproject(df: DataFrame, cameras: DataFrame, pixel: str = "pixel") -> DataFrame:
    """df(camera_id, pixel) with column ray; null without a pixel, for a ray of no length and for an unknown model. A null parameter counts as 0.

    Batches of rows are unprojected as arrays; by columns only where a
    registered model has no array functions.
    """
    both, models = with_camera(df, cameras), ArrayModels()
    if set(MODELS) - set(models.kinds):
        return both.withColumn("ray", unproject_column(F.col(pixel), F.col("camera"))).drop("camera")
    # where the work begins each row has its model's name and numbers, flat
    kept = [c for c in df.columns if c != "ray"]
    flat = both.select(*kept, F.col(f"{pixel}.u").cast("double").alias("__u"), F.col(f"{pixel}.v").cast("double").alias("__v"), F.col("camera.model").alias("__model"), *[F.col(f"camera.{n}").cast("double").alias(f"__{n}") for n in PARAMETERS])
    schema = T.StructType([flat.schema[c] for c in kept] + [T.StructField("ray", T.ArrayType(T.DoubleType()))])
    known = list(models.kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(f"__{n}").to_numpy(zero_copy_only=False) for n in ("u", "v", *PARAMETERS)]
            names = batch.column("__model")
            kind = pc.index_in(names, pa.array(known, names.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            lens = arrays.Lenses(np.stack([np.maximum(kind, 0).astype(float), *[np.nan_to_num(x) for x in given[2:]]], -1), models.functions)
            ray = arrays.unproject(np.stack(given[:2], -1), lens)
            none = (kind < 0) | np.isnan(ray).any(1)
            sizes = np.append(0, np.cumsum(np.where(none, 0, 3))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes, mask=np.append(none, False)), pa.array(ray[~none].ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, "ray"])

    return flat.mapInArrow(run, schema)


def in_image(pixel: Column, width: Column, height: Column) -> Column:
    """Whether a pixel lies in [0, width) x [0, height); false for NaN."""
    return ~F.isnan(pixel["u"]) & ~F.isnan(pixel["v"]) & (pixel["u"] >= 0) & (pixel["u"] < width) & (pixel["v"] >= 0) & (pixel["v"] < height)


def camera_problem(camera: Column) -> Column:
    """Why a camera row is not usable, null for a good one."""
    reason = F.when(camera["model"].isNull(), "missing field: model")
    for name in ("image_width", "image_height"):
        reason = reason.when(camera[name].isNull(), f"missing field: {name}").when(camera[name] <= 0, f"{name} must be positive")
    reason = reason.when(~camera["model"].isin(*MODELS), F.concat(F.lit("unknown camera model: "), camera["model"]))
    for known, model in MODELS.items():
        for name in model.required:
            if name in PARAMETERS:
                reason = reason.when((camera["model"] == known) & camera[name].isNull(), f"missing field: {name}")
    for name in ("fx", "fy"):
        reason = reason.when(~(camera[name] > 0) | F.isnan(camera[name]), f"{name} must be positive")
    return reason


def check_cameras(cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid cameras, rejected cameras with column reason)."""
    row = F.struct(*cameras.columns)
    marked = cameras.withColumn("reason", camera_problem(row))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
