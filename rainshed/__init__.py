"""Receptor-day panel analytics on Spark DataFrames."""
