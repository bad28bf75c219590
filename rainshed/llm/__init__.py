"""Operators of a training-data pipeline: duplicates, search, classifiers, token files, mixing, URL filters, scoring."""
