"""Schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _B, _I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()

POSE = T.StructType([T.StructField("R", T.ArrayType(T.ArrayType(_D))), T.StructField("t", T.ArrayType(_D))])
CORNERS = T.ArrayType(T.StructType([T.StructField("u", _D), T.StructField("v", _D)]))


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


IMAGES = _table(image_id=_L, rel_path=_S, size_bytes=_L, mtime_ms=_L, width=_I, height=_I, ignored=_B, missing=_B, detection_status=_S, modified_since_detection=_B, indexed_at=_S)
DETECTIONS = _table(detection_id=_L, image_id=_L, detector_run_id=_L, marker_family=_S, dictionary_name=_S, marker_id=_L, corners=CORNERS, corner_refinement_method=_S)
OBSERVATIONS = _table(obs_id=_L, image_id=_L, detection_id=_L, marker_id=_L, success=_B, T_C_M=POSE, reprojection_error_px=_D, error_message=_S)
CAMERA_POSES = _table(image_id=_L, T=POSE, source_marker_id=_L, reprojection_error_px=_D)
MARKER_POSES = _table(marker_id=_L, T=POSE, source_image_id=_L, reprojection_error_px=_D, is_anchor=_B)
REPROJECTION_ERRORS = _table(run_id=_L, image_id=_L, marker_id=_L, corner=_I, error_px=_D, residual_x_px=_D, residual_y_px=_D, is_outlier=_B)
FEATURES = _table(image_id=_L, feature_idx=_L, x=_D, y=_D, score=_D, descriptor=T.ArrayType(T.FloatType()))
FRAME_PAIRS = _table(image_id_a=_L, image_id_b=_L, status=_S, baseline_m=_D, optical_axis_angle_deg=_D, common_marker_count=_L, estimated_overlap_score=_D, num_raw_matches=_L, num_epipolar_inliers=_L)
PAIR_MATCHES = _table(match_id=_L, pair_id=_L, feature_idx_a=_L, feature_idx_b=_L, x_a=_D, y_a=_D, x_b=_D, y_b=_D, match_score=_D, epipolar_error=_D, is_epipolar_inlier=_B)
POINTS = _table(point_id=_L, track_id=_L, x=_D, y=_D, z=_D, mean_reprojection_error_px=_D, max_reprojection_error_px=_D, num_observations=_L, source=_S, is_active=_B)
CAMERAS = _table(camera_id=_S, model=_S, image_width=_I, image_height=_I, fx=_D, fy=_D, cx=_D, cy=_D, xi=_D, k1=_D, k2=_D, p1=_D, p2=_D, k3=_D)
