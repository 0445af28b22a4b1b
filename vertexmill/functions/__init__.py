"""Column builders: geometry of poses and cameras, robust losses."""
