"""Selection of frame pairs: each image's best partners in a range self-join of camera poses."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexmill.functions import geometry as g
from vertexmill.plans.checkpoints import written

#: Cells from the largest distance down to one part in 2 ** LEVELS of it.
LEVELS = 7
#: The first cells hold about so many images, where that many stand close enough.
CELL_IMAGES = 128
#: Images of a cell, and images around it, that one group holds; a cell with more is dealt into several.
CELL_ROWS, AROUND_ROWS = 4096, 65536
#: Pairs that a group compares at once.
STEP_PAIRS = 1 << 18
BONUS = 0.2
_SHIFTS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
_PAIRS = "image_id_a long, image_id_b long, baseline_m double, optical_axis_angle_deg double, common_marker_count long, estimated_overlap_score double"


def _cell(width: float) -> list[Column]:
    return [F.floor(F.col(c) / width).alias(f"c{i}") for i, c in enumerate("xyz")]


def best_in_cells(some: DataFrame, every: DataFrame, width: float, **limits) -> DataFrame:
    """Of the ordered pairs of images of some and of every whose centres are within width, the best of each image of some, by a grid of that width.

    A cell's images of some meet those of every in it and in the 26 cells around
    it as arrays. A cell of very many images, in it or around it, is dealt into
    groups of bounded size, so an image may have its best from each.
    """
    at = ["c0", "c1", "c2"]
    homes = every.groupBy(*_cell(width)).agg(F.count("*").alias("n"))
    cells = some.groupBy(*_cell(width)).agg(F.count("*").alias("own"))
    around = F.explode(F.array(*[F.struct(*[(F.col(f"c{n}") + s).alias(f"c{n}") for n, s in enumerate(shift)]) for shift in _SHIFTS])).alias("to")
    links = written(homes.select(F.struct(*at).alias("home"), "n", around).select("to.*", "home", "n").join(cells, at))
    parts = links.groupBy(*at).agg(F.ceil(F.first("own") / CELL_ROWS).alias("rows"), F.ceil(F.sum("n") / AROUND_ROWS).alias("slices"))
    parts = written(parts)
    deal = lambda count, salt: F.pmod(F.xxhash64("image_id", F.lit(salt)), F.col(count)).alias(count)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(count)
    a = some.select(*_cell(width), *some.columns).join(parts.hint("merge"), at).select(*at, deal("rows", 3), each("slices"), *some.columns)
    to = links.select(*[F.col(f"home.{c}").alias(f"h{c}") for c in at], *at).join(parts.hint("merge"), at)
    b = every.select(*[c.alias(f"hc{i}") for i, c in enumerate(_cell(width))], *every.columns).join(to.hint("merge"), [f"h{c}" for c in at]).select(*at, deal("slices", 4), each("rows"), *every.columns)
    key = [*at, "rows", "slices"]
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of their own beside those of a
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(partial(_best, width=width, **limits), _PAIRS)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, centres and axes, a row a coordinate."""
    return rows["image_id"].to_numpy(), *[np.array([rows[c].to_numpy() for c in of]) for of in (("x", "y", "z"), ("ax", "ay", "az"))]


def _best(some: pa.Table, every: pa.Table, width: float, min_baseline: float, max_angle_deg: float, min_common: int, most: int, bonus: bool) -> pa.Table:
    """The best partners of each image of some in every, some rows of the matrix of all pairs at a time; sums in the order of the columns of geometry."""
    ids, centre, axis = _arrays(some)
    other, centres, axes = _arrays(every)
    far = np.minimum(some["reach"].to_numpy(), width)
    worst = some["worst"].to_numpy()
    sizes = pc.list_value_length(some["markers"]).to_numpy()
    ends = np.cumsum(sizes)
    wanted = pc.list_flatten(some["markers"]).to_numpy()
    marker = pc.list_flatten(every["markers"]).to_numpy()
    place = np.repeat(np.arange(len(other)), pc.list_value_length(every["markers"]).to_numpy())
    order = np.argsort(marker, kind="stable")
    names, first = np.unique(marker[order], return_index=True)
    seers = dict(zip(names.tolist(), np.split(place[order], first[1:]), strict=True)) if len(names) else {}
    # pairs whose cosine is this close to the limit's are judged by the angle
    limit, margin = np.cos(np.radians(np.clip(max_angle_deg, 0.0, 180.0))), 1e-9
    step = max(1, STEP_PAIRS // max(1, len(other)))
    out = []
    for s in range(0, len(ids) if len(other) else 0, step):
        rows = slice(s, s + step)
        x, y, z = (centre[i, rows, None] - centres[i] for i in range(3))
        baseline = np.sqrt(x * x + y * y + z * z)
        u, v, w = (axis[i, rows, None] * axes[i] for i in range(3))
        # as least and greatest of columns, which take NaN for the largest
        cosine = np.fmax(-1.0, np.fmin(1.0, u + v + w))
        fits = (baseline >= min_baseline) & (baseline <= far[rows, None]) & (cosine >= limit - margin) & (ids[rows, None] != other)
        close = np.nonzero(fits & (cosine <= limit + margin))
        fits[close] = np.degrees(np.arccos(cosine[close])) <= max_angle_deg
        common = np.zeros(fits.shape, np.int32)
        for r, (size, end) in enumerate(zip(sizes[rows], ends[rows], strict=True)):
            for m in wanted[end - size : end].tolist():
                if m in seers:
                    common[r, seers[m]] += 1
        score = 1 / (1 + baseline) + (BONUS * common if bonus else 0.0)
        fits &= (common >= min_common) & (score >= worst[rows, None])
        if len(other) > most:
            ranked = np.where(fits, score, -np.inf)
            ranked.partition(len(other) - most, axis=1)
            fits &= score >= ranked[:, len(other) - most, None]
        i, j = np.nonzero(fits)
        a, b, value = ids[rows][i], other[j], score[i, j]
        best = np.lexsort((np.maximum(a, b), np.minimum(a, b), -value, i))
        i, j = i[best], j[best]
        starts = np.searchsorted(i, np.arange(fits.shape[0]))
        kept = np.arange(len(i)) - starts[i] < most
        i, j = i[kept], j[kept]
        out.append((ids[rows][i], other[j], baseline[i, j], np.degrees(np.arccos(cosine[i, j])), common[i, j].astype(np.int64), score[i, j]))
    names = [c.split()[0] for c in _PAIRS.split(", ")]
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.float64 if "double" in c else np.int64) for c in _PAIRS.split(", ")]
    return pa.table(dict(zip(names, columns, strict=True)))


def _start(placed: DataFrame, max_baseline: float) -> int:
    """The level whose cells are the smallest that hold CELL_IMAGES on average."""
    seen = placed.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.struct(*_cell(max_baseline / 2**k))).alias(f"l{k}") for k in range(LEVELS + 1)]).first()
    return max((k for k in range(LEVELS + 1) if seen["n"] >= CELL_IMAGES * max(1, seen[f"l{k}"])), default=0)


def select_frame_pairs(poses: DataFrame, detections: DataFrame, min_baseline: float = 0.03, max_baseline: float = 5.0, max_angle_deg: float = 60.0, min_common: int = 0, most: int = 10, bonus: bool = True) -> DataFrame:
    """The frame pairs to match, with status candidate: those among the best `most` of either image, ties to smaller ids. poses(image_id, T), detections(image_id, marker_id).

    The nearest cells come first. At each level an image meets those within the
    level's cell width, and keeps its best. A pair's score is at most
    1 / (1 + distance) and the bonus for all of the image's markers; an image
    whose last place beats that bound at the cell's width is done, as no one
    further off can enter. Only the others go on, at twice the width, up to
    max_baseline, and look no further than their bound allows. Images are copied
    only to the cells around them where one is looking. An image without a pose
    or id is in no pair.
    """
    markers = detections.groupBy("image_id").agg(F.collect_set("marker_id").alias("markers"))
    centre, axis = F.col("T.t"), g.optical_axis(F.col("T"))
    placed = poses.filter("image_id is not null and T is not null").select("image_id", *[centre[i].cast("double").alias(c) for i, c in enumerate("xyz")], *[axis[i].alias(f"a{c}") for i, c in enumerate("xyz")])
    # without a centre or an axis there is no distance or angle
    placed = placed.filter(" and ".join(f"{c} is not null" for c in placed.columns)).join(markers, "image_id", "left")
    placed = written(placed.withColumn("markers", F.coalesce("markers", F.array().cast("array<long>"))))
    looking, done = placed.withColumns({"worst": F.lit(-1.0), "reach": F.lit(float(max_baseline))}), []
    score = F.col("estimated_overlap_score")
    place = F.row_number().over(Window.partitionBy("image_id_a").orderBy(F.desc(score), F.least("image_id_a", "image_id_b"), F.greatest("image_id_a", "image_id_b")))
    # what markers can add at most, and so how far an image must look
    extra = BONUS * F.size("markers") if bonus else F.lit(0.0)
    reach = F.when(F.col("worst") - extra > 0, 1 / (F.col("worst") - extra) - 1).otherwise(max_baseline)
    for level in range(_start(placed, max_baseline), -1, -1):
        width = max_baseline / 2**level
        met = best_in_cells(looking, placed, width, min_baseline=min_baseline, max_angle_deg=max_angle_deg, min_common=min_common, most=most, bonus=bonus)
        best = written(met.withColumn("place", place).filter(F.col("place") <= most).drop("place"))
        done.append(best)
        if not level:
            break
        worst = best.groupBy("image_id_a").agg(F.count("*").alias("n"), F.min(score).alias("low")).filter(F.col("n") >= most)
        tried = looking.drop("worst", "reach").join(worst.select(F.col("image_id_a").alias("image_id"), "low"), "image_id", "left").withColumn("worst", F.coalesce("low", F.lit(-1.0)))
        # the square root's and the quotient's last bits are left a margin
        open_ = tried.withColumn("reach", F.least(reach * (1 + 1e-9) + 1e-9, F.lit(max_baseline))).filter((F.col("worst") < 0) | (F.col("reach") >= width))
        looking = written(open_.select(*looking.columns))
        # a later level finds all of an open image's pairs again
        closed = looking.select(F.col("image_id").alias("image_id_a"))
        done[-1] = best.join(closed, "image_id_a", "left_anti")
        if looking.isEmpty():
            break
    ordered = reduce(DataFrame.union, done).withColumns({"image_id_a": F.least("image_id_a", "image_id_b"), "image_id_b": F.greatest("image_id_a", "image_id_b")})
    return ordered.dropDuplicates(["image_id_a", "image_id_b"]).withColumn("status", F.lit("candidate"))
