"""Operators over DataFrames; each names the tables it needs."""
