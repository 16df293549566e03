"""Whole jobs over the operators, and the queries registered for checking."""
