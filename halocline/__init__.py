"""Geo-observation analytics as Spark jobs."""
