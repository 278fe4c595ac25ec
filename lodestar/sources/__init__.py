"""Readers: each gives plain DataFrames."""
