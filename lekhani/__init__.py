"""Lekhani: a Spark-first engine for text corpora, retrieval and retrieval evaluation."""

__version__ = "0.1.0"
