"""Spark jobs over the data of a caching query gateway."""
