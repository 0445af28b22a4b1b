"""Bundle adjustment of camera and marker poses, residuals and outliers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam
from vertexmill.functions import geometry as g
from vertexmill.functions.losses import loss
from vertexmill.operators.poses import pose_structs
from vertexmill.plans.checkpoints import cut, discard, written

PENALTY = 1e6
#: The reduced system comes to the driver if it has so many blocks (of 48 numbers, 96 MB) at most, and is solved directly for so many markers at most.
MOST_BLOCKS = 250_000
MOST_MARKERS = 1000
#: Conjugate gradients end when the residual is so much of the right-hand side, or after so many steps: what they have is a descent direction, and the adjustment goes on from there.
RESIDUAL = 1e-6
MOST_STEPS = 500
#: Observations of the images that a task holds at once, about.
BUCKET_ROWS = 20_000
#: Observations whose slopes are computed at once, so that their arrays stay in a core's cache.
ROWS_AT_ONCE = 1024


class Config(NamedTuple):
    """Defaults of the adjustment."""

    loss: str = "huber"
    scale: float = 3.0
    corner_limit_px: float = 10.0
    observation_limit_px: float = 5.0
    second_pass: bool = True
    iterations: int = 100
    cost_tolerance: float = 1e-8
    gradient_tolerance: float = 1e-10
    step_tolerance: float = 1e-10
    penalty_px: float = PENALTY


def assemble(detections: DataFrame, cameras: DataFrame, markers: DataFrame, anchor: int) -> DataFrame:
    """Detections whose image has a seed pose and whose marker has one, the anchor counting as seeded."""
    spark = detections.sparkSession
    known = markers.select("marker_id").union(spark.createDataFrame([(anchor,)], "marker_id long")).distinct()
    return detections.join(cameras.select("image_id"), "image_id", "left_semi").join(known, "marker_id", "left_semi")


def residual_rows(observations: DataFrame, camera_poses: DataFrame, marker_poses: DataFrame, cameras: DataFrame, size: float, penalty: float = PENALTY) -> DataFrame:
    """(image_id, marker_id, corner, error_px, residual_x_px, residual_y_px), four rows an observation(image_id, marker_id, corners, camera_id).

    A residual is observed minus predicted; a corner that is not seen is
    predicted at the penalty.
    """
    both = observations.join(camera_poses.select("image_id", F.col("T").alias("T_W_C")), "image_id").join(marker_poses.select("marker_id", F.col("T").alias("T_W_M")), "marker_id")
    at = cam.with_camera(both, cameras).withColumn("c", F.explode(g.marker_corners(size, "detector")))
    point = g.transform_back(F.col("T_W_C"), g.transform(F.col("T_W_M"), F.col("c.point")))
    seen = at.withColumn("p", point).withColumn("pixel", F.when((F.col("p")[2] > 1e-12) & (g.norm(F.col("p")) > 1e-12), cam.project_column(F.col("p"), F.col("camera"))))
    fine = F.col("pixel").isNotNull() & ~F.isnan("pixel.u") & ~F.isnan("pixel.v")
    observed = F.col("corners")[F.col("c.corner")]
    x = observed["u"] - F.when(fine, F.col("pixel.u")).otherwise(penalty)
    y = observed["v"] - F.when(fine, F.col("pixel.v")).otherwise(penalty)
    out = seen.select("image_id", "marker_id", F.col("c.corner").alias("corner"), x.alias("residual_x_px"), y.alias("residual_y_px"))
    return out.withColumn("error_px", F.hypot("residual_x_px", "residual_y_px")).select("image_id", "marker_id", "corner", "error_px", "residual_x_px", "residual_y_px")


def residual_statistics(errors: DataFrame) -> DataFrame:
    """One row over the rows that are no outliers: mean_error_px, median_error_px (exact), max_error_px, num_corners."""
    kept = errors.filter(~F.col("is_outlier")) if "is_outlier" in errors.columns else errors
    return kept.agg(F.avg("error_px").alias("mean_error_px"), F.median("error_px").alias("median_error_px"), F.max("error_px").alias("max_error_px"), F.count("*").alias("num_corners"))


def outlier_observations(errors: DataFrame, corner_limit_px: float = 10.0, observation_limit_px: float = 5.0) -> DataFrame:
    """(image_id, marker_id, max_error_px, mean_error_px) with a corner over the one limit or a mean over the other; NaN is over neither."""
    plain = F.when(~F.isnan("error_px"), F.col("error_px"))
    nan = F.bool_or(F.isnan("error_px"))
    stats = errors.groupBy("image_id", "marker_id").agg(F.max(plain).alias("max_error_px"), F.when(~nan, F.avg("error_px")).alias("mean_error_px"))
    return stats.filter((F.col("max_error_px") > corner_limit_px) | (F.col("mean_error_px") > observation_limit_px))


class Result(NamedTuple):
    camera_poses: DataFrame
    marker_poses: DataFrame
    summary: dict


_BUCKET = "bucket int, images binary, image_at binary, markers binary, marker_at binary, pixels binary, lenses binary, lens_at binary, xi binary"


def _flat(rows: DataFrame) -> DataFrame:
    """rows(bucket, image_id, marker_id, corners, camera, T) with their numbers as columns."""
    pixels = [F.col("corners")[k][n].cast("double").alias(f"{n}{k}") for k in range(4) for n in "uv"]
    lens = [F.coalesce(F.col(f"camera.{n}").cast("double"), F.lit(0.0)).alias(n) for n in arrays.CAMERA[1:]]
    pose = [F.col("T.R")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [F.col("T.t")[i].alias(f"t{i}") for i in range(3)]
    return rows.select("bucket", "image_id", "marker_id", *pixels, F.col("camera.model").alias("model"), *lens, *pose)


def _packed(table: pa.Table, models: cam.ArrayModels) -> pa.Table:
    """A bucket's rows of _flat(), by image, as one row of arrays in bytes: ids once each, which of them a row has, its pixels and its camera; xi are the images' poses."""
    table = table.sort_by([("image_id", "ascending"), ("marker_id", "ascending")])
    column = lambda n: table.column(n).to_numpy()
    images, first, image_at = np.unique(column("image_id"), return_index=True, return_inverse=True)
    markers, marker_at = np.unique(column("marker_id"), return_inverse=True)
    names = table.column("model").combine_chunks().dictionary_encode()
    kind = models.lenses(names.dictionary.to_pylist(), [np.zeros(len(names.dictionary))] * (len(arrays.CAMERA) - 1)).values[:, 0] if names.null_count == 0 else models.lenses([None], [])
    values = np.stack([kind[names.indices.to_numpy()], *[column(n) for n in arrays.CAMERA[1:]]], -1)
    lenses, lens_at = np.unique(values, axis=0, return_inverse=True)
    R = np.stack([column(f"r{i}{j}")[first] for i in range(3) for j in range(3)], -1).reshape(-1, 3, 3)
    xi = np.concatenate([np.stack([column(f"t{i}")[first] for i in range(3)], -1), arrays.rotation_vectors(R)], 1)
    pixels = np.stack([column(f"{n}{k}") for k in range(4) for n in "uv"], -1)
    row = {"images": images, "image_at": image_at.astype(np.int32), "markers": markers, "marker_at": marker_at.astype(np.int32), "pixels": pixels, "lenses": lenses, "lens_at": lens_at.ravel().astype(np.int32), "xi": xi}
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in row.items()}})


def _lists(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of six."""
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, 6)


class _Bucket:
    """A bucket's arrays and the poses of its markers, rows of markers(marker_id, ...) in any order."""

    def __init__(self, packed: pa.Table, markers: pa.Table, models: cam.ArrayModels):
        row = packed.to_pylist()[0]
        ints = lambda n, kind: np.frombuffer(row[n], kind)
        self.number, self.images, self.at = row["bucket"], ints("images", np.int64), ints("image_at", np.int32)
        self.first = np.searchsorted(self.at, np.arange(len(self.images)))  # rows stand by image
        self.markers, self.marker_at = ints("markers", np.int64), ints("marker_at", np.int32)
        self.pixels = _floats(row["pixels"], 4, 2)
        self.camera = arrays.Lenses(_floats(row["lenses"], len(arrays.CAMERA)), models.functions)[ints("lens_at", np.int32)]
        self.xi = _floats(row["xi"], 6)
        self._table, self._order = markers, np.argsort(markers.column("marker_id").to_numpy())

    def of_markers(self, name: str) -> np.ndarray:
        """A column of the markers, a row an observation."""
        return _lists(self._table, name)[self._order][self.marker_at]

    def by_image(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first)


def _sums_by(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums of the rows of x with them)."""
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return keys, np.add.reduceat(x[order], first)


def _corners(camera_xi, marker_xi, corners):
    """Rotations of cameras and markers, and the corners (n, 4, 3) from the marker's centre and from the camera's, in the world's axes, and in the camera's frame."""
    Rc, Rm = arrays.rotations(camera_xi[:, 3:]), arrays.rotations(marker_xi[:, 3:])
    arm = np.einsum("nij,kj->nki", Rm, corners)
    away = arm + marker_xi[:, None, :3] - camera_xi[:, None, :3]
    return Rc, arm, away, np.einsum("nji,nkj->nki", Rc, away)


def _unseen(p, pixels) -> np.ndarray:
    return (p[..., 2] <= 1e-12) | ~np.isfinite(pixels).all(-1)


def _residuals(camera_xi, marker_xi, pixels, camera, corners, penalty) -> np.ndarray:
    """(n, 8) observed minus predicted."""
    p = _corners(camera_xi, marker_xi, corners)[-1]
    seen = arrays.project(p, camera[:, None, :])
    return (pixels - np.where(_unseen(p, seen)[..., None], penalty, seen)).reshape(len(pixels), 8)


def _linear(camera_xi, marker_xi, pixels, camera, corners, penalty) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (n, 8) and their derivatives (n, 8, 6) by the camera's and by the marker's translation and rotation vector; a corner at the penalty has none."""
    n = len(pixels)
    Rc, arm, away, p = _corners(camera_xi, marker_xi, corners)
    seen, slopes = arrays.project_slopes(p, camera[:, None, :])
    bad = _unseen(p, seen)
    r = (pixels - np.where(bad[..., None], penalty, seen)).reshape(n, 8)
    by_world = np.where(bad[..., None, None], 0.0, slopes) @ np.swapaxes(Rc, 1, 2)[:, None]
    turned = by_world @ arrays.cross_matrices(away) @ arrays.turn_slopes(camera_xi[:, 3:])[:, None]
    spun = by_world @ arrays.cross_matrices(arm) @ arrays.turn_slopes(marker_xi[:, 3:])[:, None]
    return r, np.concatenate([by_world, -turned], -1).reshape(n, 8, 6), np.concatenate([-by_world, spun], -1).reshape(n, 8, 6)


def _pairs_within(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs (a, b), a = b among them, of rows with the same value in at."""
    order = np.argsort(at, kind="stable")
    size = np.bincount(at[order])
    size = size[size > 0]
    first = np.cumsum(size) - size
    n, start = np.repeat(size, size), np.repeat(first, size)
    a = np.repeat(np.arange(len(at)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    return order[a], order[b]


def _damped(block: np.ndarray, damping: float) -> np.ndarray:
    """The diagonal 6 x 6 blocks of rows (n, 48), damped."""
    return block[:, :36].reshape(-1, 6, 6) + damping * block[:, 36:42, None] * np.eye(6) + 1e-12 * np.eye(6)


def solve_few(pairs: DataFrame, damping: float) -> DataFrame:
    """(marker_id, delta) of the damped reduced system pairs(i, j, block), solved on the driver: directly, or by conjugate gradients over its blocks for many markers.

    A block holds the 6 x 6 numbers of the markers i and j, then the 6 of the
    diagonal that is damped and the 6 of the gradient.
    """
    rows = pairs.toArrow()  # MOST_BLOCKS at most
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    block = rows.column("block").combine_chunks().flatten().to_numpy().reshape(len(i), 48)
    ids, at = np.unique(i, return_inverse=True)
    other, own = np.searchsorted(ids, j), i == j
    A = block[:, :36].reshape(-1, 6, 6).copy()
    A[own] = _damped(block[own], damping)
    b = np.zeros((len(ids), 6))
    b[at[own]] = -block[own, 42:]
    if len(ids) <= MOST_MARKERS:
        n = 6 * len(ids)
        whole = np.zeros((len(ids), len(ids), 6, 6))
        whole[at, other] = A
        delta = np.linalg.solve(whole.transpose(0, 2, 1, 3).reshape(n, n), b.ravel()).reshape(-1, 6)
    else:
        delta = _conjugate_gradients(A, at, other, own, b)
    return pairs.sparkSession.createDataFrame(list(zip(ids.tolist(), delta.tolist(), strict=True)), "marker_id long, delta array<double>")


def _conjugate_gradients(A: np.ndarray, at: np.ndarray, other: np.ndarray, own: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Blocks A in rows at and columns other, those of own on the diagonal, which precondition."""
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(b)))
    A, other = A[order], other[order]
    inverse = np.empty((len(b), 6, 6))
    inverse[at[own]] = np.linalg.inv(A[np.argsort(order)][own])
    x, res = np.zeros_like(b), b.copy()
    p = z = np.einsum("nrc,nc->nr", inverse, res)
    rz, enough = (res * z).sum(), RESIDUAL**2 * (res * res).sum()
    for _ in range(MOST_STEPS):
        if (res * res).sum() <= enough:
            break
        q = np.add.reduceat((A @ p[other][..., None])[..., 0], first)
        alpha = rz / (p * q).sum()
        x, res = x + alpha * p, res - alpha * q
        z = np.einsum("nrc,nc->nr", inverse, res)
        before, rz = rz, (res * z).sum()
        p = z + rz / before * p
    return x


#: Markers of a piece of a vector.
PIECE_MARKERS = 4096
_VECTOR = "c int, ids binary, inverse binary, x binary, res binary, z binary, p binary, rz double, rr double"


def _floats(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, *shape)


def solve_many(pairs: DataFrame, damping: float) -> DataFrame:
    """As solve_few, by conjugate gradients preconditioned with the diagonal blocks.

    Markers are dealt into pieces of about PIECE_MARKERS. A row of a vector
    holds a piece's numbers, a row of the matrix some thousand blocks of 6 x 6
    of a pair of pieces, as bytes. A product is a join of matrix rows with the
    pieces that they meet, numpy products, sums by marker within a row, and a
    sum by piece. Only dot products come to the driver.
    """
    diagonal = pairs.filter("i = j")
    pieces = max(1, -(-diagonal.count() // PIECE_MARKERS))
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int")

    def blocks(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        return table.column("block").flatten().to_numpy().reshape(-1, 48) if isinstance(table, pa.RecordBatch) else table.column("block").combine_chunks().flatten().to_numpy().reshape(-1, 48)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, a, b = (batch.column(c).to_numpy() for c in ("i", "j", "a", "b"))
            block = blocks(batch)
            plain = np.where((i == j)[:, None, None], _damped(block, damping), block[:, :36].reshape(-1, 6, 6))
            edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                yield pa.RecordBatch.from_pydict({"a": a[s : s + 1], "b": b[s : s + 1], "i": [i[s:e].tobytes()], "j": [j[s:e].tobytes()], "block": [plain[s:e].tobytes()]})

    def begin(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        block = blocks(table)
        inverse, res = np.linalg.inv(_damped(block, damping)), -block[:, 42:]
        z = np.einsum("nrc,nc->nr", inverse, res)
        vectors = {"x": np.zeros_like(res), "res": res, "z": z, "p": np.zeros_like(z)}
        return pa.table({"c": table.column("a").slice(0, 1), "ids": [table.column("i").to_numpy().tobytes()], "inverse": [inverse.tobytes()], **{k: [v.tobytes()] for k, v in vectors.items()}, "rz": [float((res * z).sum())], "rr": [float((res * res).sum())]})

    dealt = pairs.select("i", "j", piece("i").alias("a"), piece("j").alias("b"), "block")
    matrix = written(dealt.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(pack, "a int, b int, i binary, j binary, block binary"))
    state = written(dealt.filter("i = j").groupBy("a").applyInArrow(begin, _VECTOR))

    def sums(state: DataFrame, *names: str) -> list[float]:
        return list(state.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first())

    def turned(state: DataFrame, beta: float) -> DataFrame:
        """p = z + beta p."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = [(_floats(z) + beta * _floats(p)).tobytes() for z, p in zip(batch.column("z").to_pylist(), batch.column("p").to_pylist(), strict=True)]
                yield batch.set_column(batch.schema.get_field_index("p"), "p", pa.array(p, pa.binary()))

        return state.mapInArrow(run, state.schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j = (np.frombuffer(row[k], np.int64) for k in "ij")
                y = np.einsum("nrc,nc->nr", _floats(row["block"], 6, 6), _floats(row["p"], 6)[np.searchsorted(np.frombuffer(row["ids"], np.int64), j)])
                mine, at = np.unique(i, return_inverse=True)
                out = np.zeros((len(mine), 6))
                np.add.at(out, at, y)
                yield pa.RecordBatch.from_pydict({"c": pa.array([row["a"]], pa.int32()), "ids": [mine.tobytes()], "y": [out.tobytes()]})

    def gather(parts: pa.Table, state: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        ids, p = np.frombuffer(row["ids"], np.int64), _floats(row["p"], 6)
        q = np.zeros_like(p)
        for part in parts.to_pylist():
            q[np.searchsorted(ids, np.frombuffer(part["ids"], np.int64))] += _floats(part["y"], 6)
        return state.append_column("q", pa.array([q.tobytes()], pa.binary())).append_column("pq", pa.array([float((p * q).sum())]))

    def stepped(state: DataFrame, alpha: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    v = {k: _floats(row[k], 6) for k in ("x", "res", "p", "q")}
                    x, res = v["x"] + alpha * v["p"], v["res"] - alpha * v["q"]
                    z = np.einsum("nrc,nc->nr", _floats(row["inverse"], 6, 6), res)
                    new = {"x": x.tobytes(), "res": res.tobytes(), "z": z.tobytes(), "rz": float((res * z).sum()), "rr": float((res * res).sum())}
                    yield pa.RecordBatch.from_pylist([{k: v for k, v in (row | new).items() if k not in ("q", "pq")}], schema=kinds)

        return state.mapInArrow(run, _VECTOR)

    kinds = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]]) for c in _VECTOR.split(", ")])
    (rz, rr), beta = sums(state, "rz", "rr"), 0.0
    enough, held = RESIDUAL**2 * rr, state
    for _ in range(MOST_STEPS):
        if rr <= enough:
            break
        now = turned(state, beta)
        parts = matrix.join(now.select(F.col("c").alias("b"), "ids", "p"), "b").select("a", "i", "j", "block", "ids", "p").mapInArrow(multiply, "c int, ids binary, y binary")
        whole = written(parts.groupBy("c").cogroup(now.groupBy("c")).applyInArrow(gather, _VECTOR + ", q binary, pq double"))
        discard(held)
        held, state = whole, stepped(whole, rz / sums(whole, "pq")[0])
        before, (rz, rr) = rz, sums(state, "rz", "rr")
        beta = rz / before

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"marker_id": np.frombuffer(row["ids"], np.int64), "delta": _floats(row["x"], 6).tolist()})

    out = cut(state.mapInArrow(steps, "marker_id long, delta array<double>"))
    for used in (matrix, held):
        discard(used)
    return out


def _of_lists(x: np.ndarray) -> pa.ListArray:
    """Rows of numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, marker_id) of the markers that a packed bucket sees."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["markers"], np.int64)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(len(ids), row["bucket"], np.int32)), "marker_id": pa.array(ids)})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, T) of a bucket's images and poses."""
    for batch in batches:
        for row in batch.to_pylist():
            images, xi = np.frombuffer(row["images"], np.int64), _floats(row["xi"], 6)
            yield pa.RecordBatch.from_arrays([pa.array(images), pose_structs(arrays.rotations(xi[:, 3:]), xi[:, :3], np.ones(len(xi), bool))], names=["image_id", "T"])


def bundle_adjust(observations: DataFrame, camera_poses: DataFrame, marker_poses: DataFrame, cameras: DataFrame, size: float, anchor: int, config: Config = Config()) -> Result:
    """Camera and marker poses of least robust reprojection error, the anchor marker fixed at the identity.

    observations(image_id, marker_id, corners, camera_id). Levenberg-Marquardt:
    in each iteration the tasks build each image's normal equations, remove its
    camera from them, and send their sums by pair of markers; the reduced system
    of the markers is solved on the driver if it is small, else as tables; the
    tasks put the solution back to get each camera's step and the new cost.
    Poses of images and markers, however many, stay tables.
    """
    rho, corners, models = loss(config.loss), arrays.DETECTOR_CORNERS * size, cam.ArrayModels()
    spark = observations.sparkSession
    obs = cam.with_camera(assemble(observations, camera_poses, marker_poses, anchor), cameras).select("image_id", "marker_id", "corners", "camera")
    used = obs.select("marker_id").distinct()
    seeds = marker_poses.filter(F.col("marker_id") != anchor).join(used, "marker_id", "left_semi").groupBy("marker_id").agg(F.first(g.to_vector(F.col("T"))).alias("mxi"))
    markers = cut(seeds.unionByName(spark.createDataFrame([(anchor, [0.0] * 6)], "marker_id long, mxi array<double>")))
    n_markers = markers.count()

    rows = written(obs.join(camera_poses.select("image_id", "T"), "image_id"))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = _flat(rows.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")))
    packed = written(dealt.groupBy("bucket").applyInArrow(lambda table: _packed(table, models), _BUCKET))
    discard(rows)
    held, poses = packed.drop("xi"), packed.select("bucket", "xi")
    needed = written(packed.select("bucket", "markers").mapInArrow(_needed, "bucket int, marker_id long"))

    def with_poses(markers: DataFrame):
        """Each bucket's row and the rows of the markers that it sees."""
        return held.join(poses, "bucket").groupBy("bucket").cogroup(needed.join(markers, "marker_id").groupBy("bucket"))

    def blocks(bucket: _Bucket, damping: float):
        """Squared errors (n), the images' systems, and each observation's part in the markers'."""
        n = len(bucket.at)
        r, Jc, Jm = np.empty((n, 8)), np.empty((n, 8, 6)), np.empty((n, 8, 6))
        xi, mxi = bucket.xi[bucket.at], bucket.of_markers("mxi")
        for k in range(0, n, ROWS_AT_ONCE):
            part = slice(k, k + ROWS_AT_ONCE)
            r[part], Jc[part], Jm[part] = _linear(xi[part], mxi[part], bucket.pixels[part], bucket.camera[part], corners, config.penalty_px)
        Jm[bucket.markers[bucket.marker_at] == anchor] = 0.0
        s = (r * r).sum(1)
        w = rho.weight(s, config.scale)[:, None, None]
        Jct, Jmt, wJm, wr = np.swapaxes(Jc, 1, 2), np.swapaxes(Jm, 1, 2), w * Jm, w * r[..., None]
        U = bucket.by_image(Jct @ (w * Jc))
        bc = bucket.by_image((Jct @ wr)[..., 0])
        U += np.eye(6) * (damping * np.einsum("nii->ni", U) + 1e-12)[:, None, :]
        return s, U, bc, Jct @ wJm, Jmt @ wJm, (Jmt @ wr)[..., 0]

    def evaluate(damping: float) -> tuple[DataFrame, float, float, int]:
        """The table (i, j, block) of the sums by pair of markers, the cost, the largest slope, and the number of blocks without the anchor."""
        def run(packed: pa.Table, markers: pa.Table) -> pa.Table:
            bucket = _Bucket(packed, markers, models)
            s, U, bc, W, V, bm = blocks(bucket, damping)
            at, m, n = bucket.at, bucket.marker_at.astype(np.int64), len(bucket.markers)
            solved = np.linalg.solve(U, np.concatenate([np.broadcast_to(np.eye(6), U.shape), bc[..., None]], -1))
            UW, Ub = solved[at][..., :6] @ W, solved[..., 6]
            Wt = np.swapaxes(W, 1, 2)
            own = np.concatenate([V.reshape(-1, 36), np.einsum("nii->ni", V), bm - (Wt @ Ub[at][..., None])[..., 0]], 1)
            mine, diagonal = _sums_by(m, own)
            a, b = _pairs_within(at)
            keys, both = _sums_by(m[a] * n + m[b], -(Wt[a] @ UW[b]).reshape(-1, 36))
            sums = np.concatenate([both, np.zeros((len(keys), 12))], 1)
            sums[np.searchsorted(keys, mine * (n + 1))] += diagonal  # each observation meets itself
            cost = 0.5 * rho.rho(s, config.scale).sum()
            last = np.zeros((1, 48))
            last[0, :2] = cost, np.abs(bc).max(initial=0.0)
            ids = lambda k: pa.array(np.append(bucket.markers[k], 0))
            total = np.append(np.zeros(len(keys), bool), True)
            return pa.table({"total": pa.array(total), "i": ids(keys // n), "j": ids(keys % n), "block": _of_lists(np.concatenate([sums, last]))})

        parts = written(with_poses(markers).applyInArrow(run, "total boolean, i long, j long, block array<double>"))
        block = F.col("block")
        sums = cut(parts.filter("not total").groupBy("i", "j").agg(F.array(*[F.sum(block[k]) for k in range(48)]).alias("block")))
        cost, slope = parts.filter("total").agg(F.coalesce(F.sum(block[0]), F.lit(0.0)), F.coalesce(F.max(block[1]), F.lit(0.0))).first()
        discard(parts)
        free = (F.col("i") != anchor) & (F.col("j") != anchor)
        steepest = F.max(F.when(free & (F.col("i") == F.col("j")), F.array_max(F.transform(F.slice("block", 43, 6), F.abs))))
        steep, n = sums.agg(steepest, F.count_if(free)).first()
        return sums, cost, max(slope, steep or 0.0), n

    def step_back(trial: DataFrame, damping: float) -> DataFrame:
        """trial(marker_id, mxi, delta, moved): the markers before the step, the step, and the markers after it. Result: (bucket, xi, cost)."""
        def run(packed: pa.Table, markers: pa.Table) -> pa.Table:
            bucket = _Bucket(packed, markers, models)
            _, U, bc, W, _, _ = blocks(bucket, damping)
            rhs = bc + bucket.by_image((W @ bucket.of_markers("delta")[..., None])[..., 0])
            new = bucket.xi - np.linalg.solve(U, rhs[..., None])[..., 0]
            xi, moved, r = new[bucket.at], bucket.of_markers("moved"), np.empty((len(bucket.at), 8))
            for k in range(0, len(r), ROWS_AT_ONCE):
                part = slice(k, k + ROWS_AT_ONCE)
                r[part] = _residuals(xi[part], moved[part], bucket.pixels[part], bucket.camera[part], corners, config.penalty_px)
            cost = 0.5 * rho.rho((r * r).sum(1), config.scale).sum()
            return pa.table({"bucket": pa.array([bucket.number], pa.int32()), "xi": pa.array([new.tobytes()], pa.binary()), "cost": [float(cost)]})

        return with_poses(trial).applyInArrow(run, "bucket int, xi binary, cost double")

    damping, first_cost, cost, done, last_moved = 1e-4, None, None, 0, None
    for _ in range(config.iterations):
        sums, cost, slope, n_blocks = evaluate(damping)
        first_cost = cost if first_cost is None else first_cost
        if slope < config.gradient_tolerance:
            break
        accepted = False
        while damping < 1e12:
            pairs = sums.filter((F.col("i") != anchor) & (F.col("j") != anchor))
            step = (solve_few if n_blocks <= MOST_BLOCKS else solve_many)(pairs, damping)
            delta = F.coalesce("delta", F.array(*[F.lit(0.0)] * 6))
            trial = markers.join(step, "marker_id", "left").withColumn("delta", delta)
            trial = cut(trial.withColumn("moved", F.zip_with("mxi", "delta", lambda x, y: x + y)))
            moved = written(step_back(trial, damping))
            new_cost = moved.agg(F.sum("cost")).first()[0]
            if new_cost < cost:
                accepted = True
                break
            discard(moved)
            damping *= 10
            sums, _, _, n_blocks = evaluate(damping)
        if not accepted:
            break
        change, size_of_step = cost - new_cost, trial.agg(F.max(F.array_max(F.transform("delta", F.abs)))).first()[0]
        discard(last_moved)
        last_moved = moved
        markers, poses, cost, damping, done = trial.select("marker_id", F.col("moved").alias("mxi")), moved.select("bucket", "xi"), new_cost, max(damping / 10, 1e-12), done + 1
        if change <= config.cost_tolerance * max(cost, 1e-300) or (n_markers > 1 and size_of_step < config.step_tolerance):
            break

    solved = held.select("bucket", "images").join(poses, "bucket").select("images", "xi").mapInArrow(_unpacked, f"image_id long, T {g.POSE_JSON}")
    summary = {"initial_cost": first_cost or 0.0, "final_cost": cost or 0.0, "num_iterations": done, "num_markers": n_markers}
    return Result(solved, markers.select("marker_id", g.from_vector(F.col("mxi")).alias("T"), (F.col("marker_id") == anchor).alias("is_anchor")), summary)


class Robust(NamedTuple):
    camera_poses: DataFrame
    marker_poses: DataFrame
    errors: DataFrame
    summary: dict


def robust_adjust(observations: DataFrame, camera_poses: DataFrame, marker_poses: DataFrame, cameras: DataFrame, size: float, anchor: int, config: Config = Config()) -> Robust:
    """Adjust, find outliers, adjust again without them, and score all observations with outliers marked.

    The second pass runs if it is enabled and there are outliers; without it no
    row is marked, though the outliers are counted. Cameras and markers that
    only outliers see keep the poses of the first pass.
    """
    rows = cut(assemble(observations, camera_poses, marker_poses, anchor))
    first = bundle_adjust(rows, camera_poses, marker_poses, cameras, size, anchor, config)
    errors = cut(residual_rows(rows, first.camera_poses, first.marker_poses, cameras, size, config.penalty_px))
    outliers = cut(outlier_observations(errors, config.corner_limit_px, config.observation_limit_px).select("image_id", "marker_id"))
    n = outliers.count()
    if not (config.second_pass and n):
        return Robust(first.camera_poses, first.marker_poses, errors.withColumn("is_outlier", F.lit(False)), first.summary | {"num_outlier_observations": n})
    kept = rows.join(outliers, ["image_id", "marker_id"], "left_anti")
    second = bundle_adjust(kept, first.camera_poses, first.marker_poses, cameras, size, anchor, config)
    c = second.camera_poses.unionByName(first.camera_poses.join(second.camera_poses.select("image_id"), "image_id", "left_anti"))
    m = second.marker_poses.unionByName(first.marker_poses.join(second.marker_poses.select("marker_id"), "marker_id", "left_anti"))
    c, m = cut(c), cut(m)
    scored = residual_rows(rows, c, m, cameras, size, config.penalty_px).join(outliers.withColumn("hit", F.lit(True)), ["image_id", "marker_id"], "left")
    scored = scored.withColumn("is_outlier", F.coalesce("hit", F.lit(False))).drop("hit")
    return Robust(c, m, scored, second.summary | {"initial_cost": first.summary["initial_cost"], "num_outlier_observations": n})


def usable_frames(frames: DataFrame, least_corners: int = 8, least_frames: int = 5) -> DataFrame:
    """Calibration frames(name, width, height, num_corners) with enough corners and the size of the first such frame by name; none if they are too few."""
    enough = frames.filter(F.col("num_corners") >= least_corners)
    size = enough.agg(F.min_by(F.struct("width", "height"), "name").alias("size"))
    same = enough.crossJoin(F.broadcast(size)).filter((F.col("width") == F.col("size.width")) & (F.col("height") == F.col("size.height"))).drop("size")
    gate = same.agg(F.count("*").alias("n")).filter(F.col("n") >= least_frames)
    return same.join(F.broadcast(gate), F.lit(True), "left_semi")
