"""Sketch-based sequence analytics and corpus preparation as Spark jobs."""
