"""Operators: every function takes and returns DataFrames and collects nothing."""
