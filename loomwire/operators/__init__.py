"""Operators of the fusion engine."""
