"""Operators over DataFrames; each module documents its defined results for dirty input."""
