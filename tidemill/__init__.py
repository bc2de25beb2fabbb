"""Spark jobs for bar research and for large text corpora."""
