"""Spark-first analytics over contests: groups of competitors that meet in races over time."""
