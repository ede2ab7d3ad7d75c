"""Corpus analytics as Spark DataFrame transformations."""
