"""Tarn: search-style analytics over typed document tables, written as Spark plans."""
