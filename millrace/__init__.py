"""Bulk table intake on Spark: scan, structure, profile, match, validate, render."""
