"""Spark-first entity linking and knowledge alignment."""
