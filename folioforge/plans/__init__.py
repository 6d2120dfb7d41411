"""Whole pipelines: the question-answering engine, and the catalogue of queries with their SQL."""
