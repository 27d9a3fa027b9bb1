"""Plans of the fusion engine."""
