"""Streaming of the fusion engine."""
