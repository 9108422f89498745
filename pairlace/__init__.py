"""Pairwise coupling analytics for aligned categorical data, written as Spark jobs."""

__version__ = "0.1.0"
