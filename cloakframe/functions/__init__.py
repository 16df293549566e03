"""Column expressions and driver-side value functions."""
