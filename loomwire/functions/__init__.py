"""Functions of the fusion engine."""
