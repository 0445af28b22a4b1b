"""Readers: image folders, detections, camera parameters, features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexmill import schemas
from vertexmill.functions.cameras import camera_problem

#: The extensions that count as images.
EXTENSIONS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff")
DICTIONARY_PREFIX = "DICT_APRILTAG"


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(rel_path, path, size_bytes, mtime_ms) of the image files directly in a folder; the files' content is not read. Spark lists no file without a byte."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")
    return files.filter(wanted).select(name.alias("rel_path"), "path", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))


def with_dimensions(scan: DataFrame, folder: str) -> DataFrame:
    """scan with width and height, null where an image cannot be decoded. It decodes pixels: use it on new and changed rows."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    decoded = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))  # the image source gives a URI, binaryFile a path
    image = scan.sparkSession.read.format("image").option("dropInvalid", False).load(folder).select("image.origin", "image.width", "image.height")
    known = image.select(plain(decoded).alias("origin"), *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("width", "height")])
    return scan.join(known, plain(F.col("path")) == F.col("origin"), "left").drop("origin")


def marker_family(dictionary: Column, detector_type: Column) -> Column:
    """apriltag for AprilTag detectors or dictionaries, else aruco."""
    return F.when((F.lower(detector_type) == "apriltag") | dictionary.startswith(DICTIONARY_PREFIX), "apriltag").otherwise("aruco")


def read_detections(raw: DataFrame) -> DataFrame:
    """raw with corners_json, [[u, v], ...], parsed to corners; a column reason says why corners are null. Rows keep their order only at a sink: sort by image_id and marker_id there."""
    parsed = F.from_json("corners_json", "array<array<double>>")
    whole = (F.size(parsed) == 4) & F.forall(parsed, lambda p: F.size(p) == 2)
    corners = F.when(whole, F.transform(parsed, lambda p: F.struct(p[0].alias("u"), p[1].alias("v"))))
    return raw.withColumn("corners", corners).withColumn("reason", F.when(F.col("corners").isNull(), "four corners of two numbers are needed")).drop("corners_json")


_FIELDS = {"": ("model", "image_width", "image_height"), "intrinsics": ("fx", "fy", "cx", "cy"), "omni": ("xi",), "distortion": ("k1", "k2", "p1", "p2", "k3")}


def read_cameras(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) cameras from XML files of one <camera> element each; camera_id is the file's name.

        <camera> <model/> <image_width/> <image_height/>
          <intrinsics> <fx/> <fy/> <cx/> <cy/> </intrinsics>
          <omni> <xi/> </omni>   (omni_radtan)
          <distortion> <k1/> <k2/> <p1/> <p2/> <k3/> </distortion>
        </camera>

    A file is rejected, once and with what could be read of it, if it has no
    such element or several, if it is not well formed, if a field that its
    model needs is missing, empty or no number, if the model is unknown, or if
    a size or focal length is not positive. Spark lists no file without a byte.
    """
    text = lambda names: ", ".join(f"{n} string" for n in names)
    schema = ", ".join([text(_FIELDS[""]), *[f"{g} struct<{text(f).replace(' string', ': string')}>" for g, f in _FIELDS.items() if g], "malformed string"])
    rows = spark.read.schema(schema).option("rowTag", "camera").option("columnNameOfCorruptRecord", "malformed").xml(path).select("*", "_metadata.file_path")
    where = {f: F.trim(f"{g}.{f}" if g else f) for g, fields in _FIELDS.items() for f in fields}
    flat = rows.select("file_path", "malformed", *[F.when(v != "", v).alias(f) for f, v in where.items()])
    counted = flat.groupBy("file_path").agg(F.count("*").alias("elements"), F.min(F.struct("malformed", *where)).alias("row"))
    files = spark.read.format("binaryFile").load(path).select("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    decoded = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    both = files.join(counted, plain(F.col("path")) == plain(decoded), "left")

    kind = {f.name: f.dataType for f in schemas.CAMERAS}
    integer, number = "^[+-]?[0-9]+$", "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    value = {f: F.col(f"row.{f}") for f in where}
    wrong = F.when(F.col("elements").isNull(), "no <camera> element").when(F.col("elements") > 1, "several <camera> elements").when(F.col("row.malformed").isNotNull(), "not well formed")
    for f, v in value.items():
        if f != "model":
            wrong = wrong.when(~v.rlike(integer if kind[f].typeName() == "integer" else number), f"not a number: {f}")
    read = both.select(F.element_at(F.split("path", "/"), -1).alias("camera_id"), *[(v if f == "model" else v.try_cast(kind[f])).alias(f) for f, v in value.items()], wrong.alias("wrong"))
    marked = read.withColumn("reason", F.coalesce("wrong", camera_problem(F.struct(*schemas.CAMERAS.names)))).select(*schemas.CAMERAS.names, "reason")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def read_features(records: DataFrame) -> DataFrame:
    """One row a keypoint: (image_id, feature_idx, x, y, score, descriptor), from records with keypoints, descriptors and scores as arrays. Records without keypoints have no rows."""
    both = F.arrays_zip("keypoints", "descriptors", F.coalesce("scores", F.transform("keypoints", lambda _: F.lit(None).cast("double"))).alias("scores"))
    rows = records.select("image_id", F.posexplode(both).alias("feature_idx", "f"))
    return rows.select("image_id", F.col("feature_idx").cast("long").alias("feature_idx"), F.col("f.keypoints")[0].alias("x"), F.col("f.keypoints")[1].alias("y"), F.col("f.scores").alias("score"), F.col("f.descriptors").alias("descriptor"))


def detect(spark: SparkSession, folder: str, detector: Callable[[bytes], list[tuple[int, list[tuple[float, float]]]]]) -> DataFrame:
    """(path, marker_id, corners, error) from a user's detector over the images of a folder.

    detector(content) gives (marker_id, four corners) for each marker. Images
    in which it finds none have no row; one that it cannot read has a row with
    the error and null marker.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, int(m), [{"u": float(u), "v": float(v)} for u, v in c], None) for m, c in detector(content)]
                except Exception as e:  # the user's code, on one image
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "marker_id", "corners", "error"]).astype({"marker_id": "Int64"})

    images = spark.read.format("binaryFile").load(folder).filter(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")).select("path", "content")
    return images.mapInPandas(run, "path string, marker_id long, corners array<struct<u:double,v:double>>, error string")
