"""Spark-first analytics for model evaluation and text curation."""
