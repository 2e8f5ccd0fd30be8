"""Filtered vector search, clustering, codecs and evaluation as Spark DataFrame plans."""
