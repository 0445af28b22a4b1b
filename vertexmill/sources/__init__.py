"""Readers of images, detections, cameras and features; writers of maps and clouds."""
