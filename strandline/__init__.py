"""Spark-first analytics for biological sequence data and text corpora."""
