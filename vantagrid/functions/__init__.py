"""Part of the line-of-sight engine."""
