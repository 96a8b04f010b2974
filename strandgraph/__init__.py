"""Sequence similarity and graph link prediction as Spark DataFrame jobs."""
