"""Folioquery: document analytics expressed as Spark DataFrames."""
