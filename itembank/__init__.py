"""Spark-first analytics over assessment-item banks."""
