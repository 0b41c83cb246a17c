"""Spark-first analytics for recorded conversations."""
