"""Sources of the fusion engine."""
