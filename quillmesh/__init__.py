"""Spark-first analytics over document graphs."""
