"""Two-view geometry of matches, batch by batch on arrays, for mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vertexmill.functions import arrays
from vertexmill.functions.cameras import ArrayModels

EPSILON = 1e-12


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles of a numeric column, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def poses(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3, 3) and (n, 3) of a column of poses without nulls."""
    n = len(column)
    R, t = column.field("R"), column.field("t")
    return R.flatten().flatten().to_numpy().reshape(n, 3, 3), t.flatten().to_numpy().reshape(n, 3)


def cameras(column: pa.Array, models: ArrayModels) -> arrays.Lenses:
    """The cameras of a column of camera structs; a null parameter counts as 0."""
    return models.lenses(column.field("model").to_pylist(), [np.nan_to_num(numbers(column.field(name))) for name in arrays.CAMERA[1:]])


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors at length one; NaN for one that is nearly zero."""
    n = np.sqrt(v[..., :1] * v[..., :1] + v[..., 1:2] * v[..., 1:2] + v[..., 2:] * v[..., 2:])
    return np.where(n > EPSILON, v / np.where(n > EPSILON, n, 1.0), np.nan)


def turned(R: np.ndarray, v: np.ndarray) -> np.ndarray:
    """R v of each row, term by term: sums of products in a fixed order and with every product rounded, so that plain SQL gives the same bits."""
    return np.stack([R[:, i, 0] * v[:, 0] + R[:, i, 1] * v[:, 1] + R[:, i, 2] * v[:, 2] for i in range(3)], -1)


def turned_back(R: np.ndarray, v: np.ndarray) -> np.ndarray:
    """R transposed v, likewise."""
    return turned(np.swapaxes(R, 1, 2), v)


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, likewise."""
    return x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1] + x[:, 2] * y[:, 2]


def length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(dot(v, v))


def ray_angular_error(f1: np.ndarray, f2: np.ndarray, R: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distance of ray f2 from the epipolar plane of ray f1, as a sine; the pose maps frame 1 into frame 2. Rays of any length."""
    normal = np.cross(t, turned(R, unit(f1)))
    n = length(normal)
    error = np.abs(dot(normal, unit(f2))) / np.where(n > EPSILON, n, np.nan)
    return np.where(np.isnan(error), np.inf, error)


def sampson_error(f1: np.ndarray, f2: np.ndarray, R: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First-order squared distance to the epipolar constraint, on rays scaled to z = 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = f1 / f1[:, 2:], f2 / f2[:, 2:]
        line = np.cross(t, turned(R, a))
        back = turned_back(R, np.cross(b, t))
        value = dot(b, line)
        scale = line[:, 0] * line[:, 0] + line[:, 1] * line[:, 1] + back[:, 0] * back[:, 0] + back[:, 1] * back[:, 1]
        return np.where(scale > EPSILON, value * value / np.where(scale > EPSILON, scale, 1.0), np.inf)


def with_columns(df: DataFrame, schema: str, build: Callable[[pa.RecordBatch], dict[str, np.ndarray]], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns that build(batch) gives, without those named in drop. schema: of the new columns."""
    new = T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c not in drop and c not in new.names]
    whole = T.StructType([df.schema[c] for c in kept] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = build(batch)
            columns = [pa.array(np.ascontiguousarray(made[f.name])) if made[f.name].ndim == 1 else _lists(made[f.name]) for f in new.fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *new.names])

    return df.mapInArrow(run, whole)


def _lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))
