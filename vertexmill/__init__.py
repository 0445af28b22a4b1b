"""DataFrame jobs that turn photographs' marker detections into 3D maps."""
