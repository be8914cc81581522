"""Wearable-session analytics as Spark jobs."""
