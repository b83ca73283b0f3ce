"""Compositions of the operators into the three accounting runs and their validation."""
