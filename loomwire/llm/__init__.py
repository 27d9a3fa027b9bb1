"""Operators that prepare corpora for training language models."""
