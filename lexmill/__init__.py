"""Lexmill: a Spark-first engine for searching, ranking and maintaining document collections."""
