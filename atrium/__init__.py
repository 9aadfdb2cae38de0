"""Atrium: analytics over many indoor maps, as Spark jobs."""
