"""Spark-first engine for matching documents, cleaning labelled pairs and preparing text corpora."""

__version__ = "0.1.0"
