"""The image catalog, replaceable tables, settings and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Statuses that a changed file makes stale.
DETECTED = ("detected", "no_markers", "stale")


def sync_catalog(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    """The catalog after a scan, with column change: new, updated, unchanged, missing or gone (missing before).

    catalog(rel_path, size_bytes, mtime_ms, width, height, ignored, missing,
    detection_status, modified_since_detection), scan(rel_path, size_bytes,
    mtime_ms, width?, height?). A changed file whose markers were looked for
    becomes stale and modified; any other keeps its status. Updated rows take
    the scan's width and height even if null, unchanged ones only fill gaps.
    ignored survives; a file that is there again is no longer missing.
    """
    for name in ("width", "height"):
        if name not in scan.columns:
            scan = scan.withColumn(name, F.lit(None).cast("int"))
        if name not in catalog.columns:
            catalog = catalog.withColumn(name, F.lit(None).cast("int"))
    c, s = catalog.alias("c"), scan.alias("s")
    both = c.join(s, F.col("c.rel_path") == F.col("s.rel_path"), "full_outer")
    is_new, is_gone = F.col("c.rel_path").isNull(), F.col("s.rel_path").isNull()
    same = (F.col("c.size_bytes") == F.col("s.size_bytes")) & (F.col("c.mtime_ms") == F.col("s.mtime_ms"))
    change = F.when(is_new, "new").when(is_gone & F.col("c.missing"), "gone").when(is_gone, "missing").when(same, "unchanged").otherwise("updated")
    marked = both.withColumn("change", change)
    updated = F.col("change") == "updated"
    was = F.col("c.detection_status").isin(*DETECTED)

    def size(name: str) -> Column:
        return F.when(is_gone, F.col(f"c.{name}")).when(F.col("change") == "unchanged", F.coalesce(f"s.{name}", f"c.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    carried = [F.col(f"c.{n}") for n in catalog.columns if n not in {"rel_path", "size_bytes", "mtime_ms", "width", "height", "ignored", "missing", "detection_status", "modified_since_detection"}]
    return marked.select(
        *carried, F.coalesce("s.rel_path", "c.rel_path").alias("rel_path"), F.coalesce("s.size_bytes", "c.size_bytes").alias("size_bytes"), F.coalesce("s.mtime_ms", "c.mtime_ms").alias("mtime_ms"),
        size("width"), size("height"), F.coalesce("c.ignored", F.lit(False)).alias("ignored"), is_gone.alias("missing"),
        F.when(is_new, "not_run").when(updated & was, "stale").otherwise(F.col("c.detection_status")).alias("detection_status"),
        F.when(is_new, False).when(updated, was).otherwise(F.col("c.modified_since_detection")).alias("modified_since_detection"), "change",
    )


def index_summary(synced: DataFrame) -> DataFrame:
    """One row: found, new, updated, missing (newly), unchanged."""
    n = lambda *names: F.count_if(F.col("change").isin(*names))
    return synced.agg(n("new", "updated", "unchanged").alias("found"), n("new").alias("new"), n("updated").alias("updated"), n("missing").alias("missing"), n("unchanged").alias("unchanged"))


def set_flag(table: DataFrame, keys: DataFrame, key: str, flag: str, value: bool) -> DataFrame:
    """table with the flag set to value in the rows whose key is in keys."""
    hit = keys.select(key).distinct().withColumn("flag_hit", F.lit(True))
    out = table.join(hit, key, "left").withColumn(flag, F.when(F.col("flag_hit"), F.lit(value)).otherwise(F.col(flag)))
    return out.select(*table.columns)


def path_order(path: str = "rel_path") -> Column:
    """A key that orders paths with A-Z as a-z; other letters keep their case."""
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def list_images(images: DataFrame, detections: DataFrame, include_missing: bool = True) -> DataFrame:
    """images with num_markers, zero included; order it by path_order() at a sink."""
    shown = images if include_missing else images.filter(~F.col("missing"))
    counts = detections.groupBy("image_id").agg(F.count("*").alias("num_markers"))
    return shown.join(counts, "image_id", "left").withColumn("num_markers", F.coalesce("num_markers", F.lit(0).cast("long")))


def detectable(images: DataFrame) -> DataFrame:
    return images.filter(~F.col("missing") & ~F.col("ignored"))


def status_flags(images: DataFrame) -> DataFrame:
    """images with is_detected and is_stale."""
    modified = F.col("modified_since_detection")
    return images.withColumn("is_detected", F.col("detection_status").isin("detected", "no_markers") & ~modified).withColumn("is_stale", modified | (F.col("detection_status") == "stale"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """old without the rows of keys, and new. A task holds its part of the keys; the rows of old pass by unsorted."""
    return old.join(keys.select(*key).distinct().hint("shuffle_hash"), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_detections(images: DataFrame, old: DataFrame, new: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, detections) after a detector run over the image_ids of processed; images that it could not read must not be among them."""
    detections = replace_by_key(old, new, processed, ["image_id"])
    counts = processed.select("image_id").distinct().join(new.groupBy("image_id").agg(F.count("*").alias("found")), "image_id", "left").withColumn("was_run", F.lit(True))
    status = F.when(F.col("was_run"), F.when(F.coalesce("found", F.lit(0)) > 0, "detected").otherwise("no_markers")).otherwise(F.col("detection_status"))
    marked = images.join(counts, "image_id", "left").withColumn("detection_status", status).withColumn("modified_since_detection", F.when(F.col("was_run"), False).otherwise(F.col("modified_since_detection")))
    return marked.select(*images.columns), detections


def snapshot(new: DataFrame, now: Column | None = None) -> DataFrame:
    """A table's new content as a whole, with created_at filled in; write it over the old."""
    filled = F.coalesce("created_at", now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return new.withColumn("created_at", filled) if "created_at" in new.columns else new.withColumn("created_at", now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def latest_settings(log: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",), value: str = "value") -> DataFrame:
    """The latest value of each key of an append-only log; a null value is a deletion."""
    last = F.max_by(F.struct(value), F.struct(*order))
    return log.groupBy(*keys).agg(last.alias("latest")).select(*keys, F.col(f"latest.{value}").alias(value)).filter(F.col(value).isNotNull())


def read_config(value: Column, schema: T.StructType, defaults: dict, renamed: dict[str, str] | None = None) -> Column:
    """A struct from a config's JSON: defaults where a field is absent, old names read where the new one is."""
    fields = [T.StructField(f.name, f.dataType) for f in schema]
    old = [T.StructField(o, schema[n].dataType) for o, n in (renamed or {}).items()]
    parsed = F.from_json(value, T.StructType(fields + old))
    names = {n: o for o, n in (renamed or {}).items()}

    def field(f: T.StructField) -> Column:
        found = [parsed[f.name], *([parsed[names[f.name]]] if f.name in names else [])]
        return F.coalesce(*found, F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name)

    return F.struct(*map(field, schema))


def write_config(config: Column) -> Column:
    return F.to_json(config)


def fold_runs(log: DataFrame, key: str = "run_id", order: str = "seq") -> DataFrame:
    """A row a run from its start and end rows: the last value of each column that is not null."""
    rest = [c for c in log.columns if c not in {key, order}]
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def latest_successful(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row run_id, null without a success; or one for each group."""
    good = runs.filter("success")
    return good.groupBy(*by).agg(F.max("run_id").alias("run_id")) if by else good.agg(F.max("run_id").alias("run_id"))


def rows_of_run(table: DataFrame, runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """table's rows of a run, by default the latest successful one; none if there is none."""
    if run_id is not None:
        return table.filter(F.col("run_id") == run_id)
    return table.join(F.broadcast(latest_successful(runs)), "run_id", "left_semi")  # one row


def replace_run(old: DataFrame, new: DataFrame, run_id: int) -> DataFrame:
    """A table kept by run with one run's rows replaced; as a Parquet table partitioned by run_id, write new with partition overwrite."""
    return old.filter(F.col("run_id") != run_id).unionByName(new.withColumn("run_id", F.lit(run_id).cast("long")), allowMissingColumns=True)


def evolve(table: DataFrame, schema: T.StructType, unknown: Sequence[str] = ()) -> DataFrame:
    """table with schema's missing columns added as nulls, and 'unknown' for nulls in the named columns."""
    def column(f: T.StructField) -> Column:
        have = F.col(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(have, F.lit("unknown")) if f.name in unknown else have).alias(f.name)

    extra = [F.col(c) for c in table.columns if c not in schema.names]
    return table.select(*map(column, schema), *extra)


def pending_images(images: DataFrame, features: DataFrame, mode: str, source: str, force: bool = False) -> DataFrame:
    """Images without successful features in the current format, or all."""
    if force:
        return images
    current = features.filter((F.col("status") == "success") & (F.col("extraction_mode") == mode) & (F.col("descriptor_source") == source))
    return images.join(current.select("image_id"), "image_id", "left_anti")


def pending_pairs(pairs: DataFrame, force: bool = False, most: int | None = None) -> DataFrame:
    """Pairs not matched yet, or all; the first `most` in (a, b) order on request."""
    chosen = pairs if force else pairs.filter(F.coalesce("num_raw_matches", F.lit(0)) == 0)
    return chosen if most is None else chosen.orderBy("image_id_a", "image_id_b").limit(most)


def upsert_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs by their ordered ids; a pair that comes again is a candidate again, with the new row's counters."""
    a, b = F.least("image_id_a", "image_id_b"), F.greatest("image_id_a", "image_id_b")
    fresh = new.withColumns({"image_id_a": a, "image_id_b": b, "status": F.lit("candidate")})
    return replace_by_key(old, fresh, fresh, ["image_id_a", "image_id_b"])


def replace_matches(pairs: DataFrame, old: DataFrame, new: DataFrame, processed: DataFrame, status: str = "matched") -> tuple[DataFrame, DataFrame]:
    """(pairs, matches) after matching the pair_ids of processed: counts and status follow the new rows, inliers start at 0."""
    matches = replace_by_key(old, new, processed, ["pair_id"])
    counts = processed.select("pair_id").distinct().join(new.groupBy("pair_id").agg(F.count("*").alias("raw")), "pair_id", "left").withColumn("was_run", F.lit(True))
    marked = pairs.join(counts, "pair_id", "left").withColumns({
        "status": F.when(F.col("was_run"), F.lit(status)).otherwise(F.col("status")),
        "num_raw_matches": F.when(F.col("was_run"), F.coalesce("raw", F.lit(0).cast("long"))).otherwise(F.col("num_raw_matches")),
        "num_epipolar_inliers": F.when(F.col("was_run"), F.lit(0).cast("long")).otherwise(F.col("num_epipolar_inliers")),
    })
    return marked.select(*pairs.columns), matches


def replace_triangulated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points with the triangulated ones replaced; those of other sources stay."""
    return old.filter(F.col("source") != "triangulated").unionByName(new, allowMissingColumns=True)


def activate(old: DataFrame, new: DataFrame, source: str = "merged") -> DataFrame:
    """old, all inactive, and new, all active and of the given source."""
    return old.withColumn("is_active", F.lit(False)).unionByName(new.withColumns({"is_active": F.lit(True), "source": F.lit(source)}), allowMissingColumns=True)


def move_points(points: DataFrame, refined: DataFrame, source: str = "dense_ba") -> DataFrame:
    """points with new coordinates and source where refined(point_id, x, y, z) has them; other columns stay."""
    r = refined.select("point_id", *[F.col(c).alias(f"new_{c}") for c in "xyz"])
    moved = points.join(r, "point_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in "xyz"} | {"source": F.when(F.col("new_x").isNotNull(), source).otherwise(F.col("source"))})
    return moved.select(*points.columns)


#: Orders of the listings, for sinks.
ORDERS = {
    "pairs": ("image_id_a", "image_id_b"), "matches": ("pair_id", "match_id"), "tracks": ("track_id",), "track_observations": ("track_id", "image_id", "feature_idx"),
    "points": ("point_id",), "observations": ("image_id", "marker_id"), "camera_poses": ("image_id",), "marker_poses": ("marker_id",), "errors": ("image_id", "marker_id", "corner"),
}


def listing(table: DataFrame, kind: str, **equal) -> DataFrame:
    """Rows with the given column values, in the kind's order."""
    for name, value in equal.items():
        table = table.filter(F.col(name) == value)
    return table.orderBy(*ORDERS[kind])


def pipeline_counts(features: DataFrame, pairs: DataFrame, matches: DataFrame, tracks: DataFrame, points: DataFrame) -> DataFrame:
    """One row of the pipeline's counters. Each table is scanned once."""
    good = features.filter("status = 'success'").agg(F.count("*").alias("feature_images"), F.coalesce(F.sum("num_keypoints"), F.lit(0)).alias("keypoints"))
    p = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("num_raw_matches") > 0).alias("matched_pairs"))
    m = matches.agg(F.count("*").alias("matches"), F.count_if(F.col("is_epipolar_inlier")).alias("inliers"))
    t, q = tracks.agg(F.count("*").alias("tracks")), points.agg(F.count_if(F.col("is_active")).alias("points"))
    # five tables of one row each
    one = good.withColumn("features", F.col("feature_images"))
    for other in (p, m, t, q):
        one = one.crossJoin(other)
    return one
