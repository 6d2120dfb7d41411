"""Operators over blocks, chunks, indexes and answers."""
