"""Feature tracks from matches, and their triangulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexmill.functions import arrays
from vertexmill.functions import cameras as cam
from vertexmill.functions import matches as mt
from vertexmill.operators.greedy import greedy_groups
from vertexmill.plans.checkpoints import written

#: Bits of a feature id in a node, where no id needs more.
FEATURE_BITS = 32
#: Observations that a task of the triangulation holds, about.
BUCKET_ROWS = 50_000
POINTS = ("track_id", "x", "y", "z", "mean_reprojection_error_px", "max_reprojection_error_px", "num_observations", "min_triangulation_angle_deg")


def feature_bits(matches: DataFrame) -> int:
    """The bits that the feature ids of matches need, FEATURE_BITS at least."""
    most = matches.agg(F.max(F.greatest("feature_idx_a", "feature_idx_b"))).first()[0]
    return max(FEATURE_BITS, int(most or 0).bit_length())


def feature_node(image: str, feature: str, bits: int = FEATURE_BITS):
    """One number for a feature of an image, in the order of both; ids below 0, or that need more than `bits` and 63 - `bits`, fail the job."""
    good = (F.col(image) >= 0) & (F.col(image) < 1 << 63 - bits) & (F.col(feature) >= 0) & (F.col(feature) < 1 << bits)
    node = F.shiftleft(F.col(image).cast("long"), bits).bitwiseOR(F.col(feature).cast("long"))
    return F.when(good, node).otherwise(F.raise_error("image or feature id out of range").cast("long"))


def first_coordinates(matches: DataFrame) -> DataFrame:
    """(image_id, feature_idx, x, y) of the features of matches, ids of any size; the first match in (pair_id, match_id) order gives the coordinates."""
    ends = matches.select(F.explode(F.array(*[F.struct(F.col(f"image_id_{n}").alias("image_id"), F.col(f"feature_idx_{n}").alias("feature_idx"), F.struct(F.col(f"x_{n}").alias("x"), F.col(f"y_{n}").alias("y")).alias("xy"), F.struct("pair_id", "match_id", F.lit(k).alias("side")).alias("place")) for k, n in enumerate("ab")])).alias("e")).select("e.*")
    # structs are aggregated by sorting, so they are sorted once, where they end up
    first = ends.repartition("image_id", "feature_idx").groupBy("image_id", "feature_idx").agg(F.min_by("xy", "place").alias("xy"))
    return first.select("image_id", "feature_idx", "xy.x", "xy.y")


def feature_edges(matches: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v, place) between the features of matches as nodes of feature_node()."""
    return matches.select(feature_node("image_id_a", "feature_idx_a", bits).alias("u"), feature_node("image_id_b", "feature_idx_b", bits).alias("v"), F.struct("pair_id", "match_id").alias("place"))


def track_nodes(edges: DataFrame, bits: int, task_rows: int | None = None, component: DataFrame | None = None) -> DataFrame:
    """(track_id, node) of the tracks of feature_edges(); component(node, component) may be given if it is known."""
    groups = written(greedy_groups(edges, F.shiftright("node", bits), **({} if task_rows is None else {"task_rows": task_rows}), component=component))
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).filter("n >= 2").select("root")
    return groups.join(sizes, "root").select(F.col("root").alias("track_id"), "node")


def build_tracks(matches: DataFrame, task_rows: int | None = None) -> DataFrame:
    """(track_id, image_id, feature_idx, x, y) from inlier matches(pair_id, match_id, image_id_a, feature_idx_a, x_a, y_a, image_id_b, ...).

    Matches join features in (pair_id, match_id) order; one that would put two
    features of an image into a track is refused. Tracks have two features or
    more; track_id is the smallest node of the track, of feature_bits() bits.
    """
    used = matches.filter("is_epipolar_inlier") if "is_epipolar_inlier" in matches.columns else matches
    bits = feature_bits(used)
    found = track_nodes(feature_edges(used, bits), bits, task_rows)
    where = first_coordinates(used).withColumn("node", feature_node("image_id", "feature_idx", bits))
    return found.join(where, "node").select("track_id", "image_id", "feature_idx", "x", "y")


def _points(A: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, 3) solutions; NaN where the rays do not fix a point."""
    value = np.linalg.eigvalsh(A)
    low = value[:, 0]
    good = (low > 0) & (value[:, 2] <= 1e10 * np.where(low > 0, low, 1.0))
    x = np.full((len(A), 3), np.nan)
    x[good] = np.linalg.solve(A[good], b[good][..., None])[..., 0]
    return x


def triangulate(observations: DataFrame, poses: DataFrame, cameras: DataFrame, min_observations: int = 2, min_angle_deg: float = 1.0, max_mean_px: float = 3.0, max_px: float = 6.0, max_depth: float = 100.0) -> DataFrame:
    """Points of tracks: (track_id, x, y, z, mean_reprojection_error_px, max_reprojection_error_px, num_observations, min_triangulation_angle_deg).

    observations(track_id, image_id, x, y), poses(image_id, T, camera_id). A
    track is left out if it has too few observations, two in an image, one
    without pose, rays that do not fix a point, a point that is not in front of
    all cameras or too far, too small an angle between its nearest two rays, or
    too large an error. A NaN error leaves the track out. Tracks are dealt into
    buckets with all their observations (an image each), and a bucket is solved
    at once. Poses are not broadcast: their files are much smaller than their
    rows in the driver's memory.
    """
    joined = observations.select("track_id", "image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(poses.select("image_id", "T", "camera_id").hint("merge"), "image_id", "left")
    counts = joined.groupBy("track_id").agg(F.count("*").alias("num_observations"), F.count_distinct("image_id").alias("n_images"), F.count_if(F.col("T").isNull()).alias("n_missing"))
    whole = counts.filter((F.col("num_observations") >= min_observations) & (F.col("n_images") == F.col("num_observations")) & (F.col("n_missing") == 0)).select("track_id", "num_observations")
    rows = written(cam.with_camera(joined.filter("T is not null"), cameras).join(whole.select("track_id"), "track_id"))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))

    models = cam.ArrayModels()

    def run(table: pa.Table) -> pa.Table:
        batch = table.sort_by([("track_id", "ascending"), ("image_id", "ascending")]).combine_chunks().to_batches()[0]
        ids, first, at = np.unique(batch.column("track_id").to_numpy(), return_index=True, return_inverse=True)
        (R, c), camera = mt.poses(batch.column("T")), mt.cameras(batch.column("camera"), models)
        pixel = np.stack([mt.numbers(batch.column("x")), mt.numbers(batch.column("y"))], -1)
        d = mt.unit(np.einsum("nij,nj->ni", R, arrays.unproject(pixel, camera)))
        P = np.eye(3) - d[:, :, None] * d[:, None, :]
        X = _points(np.add.reduceat(P, first), np.add.reduceat(np.einsum("nij,nj->ni", P, c), first))
        seen = arrays.project(np.einsum("nji,nj->ni", R, X[at] - c), camera)
        error, depth = np.hypot(*(seen - pixel).T), np.einsum("ni,ni->n", X[at] - c, d)
        n = np.diff(np.append(first, len(at)))
        mean = np.add.reduceat(error, first) / n
        angle = np.degrees(np.arccos(np.clip(_largest_cosine(d, first, n), -1.0, 1.0)))
        stats = (X[:, 0], X[:, 1], X[:, 2], mean, np.maximum.reduceat(error, first), n, angle)
        good = (np.minimum.reduceat(depth, first) > 0) & (np.maximum.reduceat(depth, first) <= max_depth) & (mean <= max_mean_px) & (stats[4] <= max_px) & (angle >= min_angle_deg)
        return pa.table([pa.array(v[good]) for v in (ids, *stats)], names=POINTS)

    bucket = F.pmod(F.xxhash64("track_id"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, ", ".join(f"{n} {'long' if n in ('track_id', 'num_observations') else 'double'}" for n in POINTS))


def _largest_cosine(d: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of n rays the largest cosine between two of them: every ray meets the one k places on, for each k."""
    out = np.full(len(first), -np.inf)
    run = np.repeat(np.arange(len(first)), n)
    for k in range(1, int(n.max(initial=0))):
        near = np.flatnonzero(run[:-k] == run[k:])
        np.maximum.at(out, run[near], np.einsum("ni,ni->n", d[near], d[near + k]))
    return out
