"""Spark-first analytics over scientific-literature corpora, run logs and scored systems."""
