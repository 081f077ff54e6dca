"""Operators and queries that prepare text corpora for training language models."""
